"""Session plumbing, the engine facade and the command port."""
