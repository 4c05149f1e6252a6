"""Sources of file listings and contents."""
