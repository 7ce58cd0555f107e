"""Column expressions: everything here maps columns to columns and stays inside Catalyst unless it says otherwise."""
