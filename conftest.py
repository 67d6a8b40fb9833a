"""Makes the repository root importable for the tests, however pytest is started."""
