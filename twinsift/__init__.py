"""twinsift: duplicate and near-duplicate analytics on Spark DataFrames.

The core (everything outside ``twinsift.llm``) works on file catalogs; the optional subpackage ``twinsift.llm`` adds
operators for training data. The core never imports the subpackage.
"""

__version__ = "0.1.0"
