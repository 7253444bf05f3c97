"""Where points come from and go to: stores, snapshots, JSON, HTTP."""
