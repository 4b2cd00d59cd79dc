"""Where tables come from and go to: checkouts, registries, stores, diffs, snapshots."""
