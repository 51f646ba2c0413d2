"""The growing history as a stream of snapshots."""
