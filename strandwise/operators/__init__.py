"""Set-at-a-time operators over molecules, features, reads and primers."""
