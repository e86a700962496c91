"""What this library raises for callers to tell apart; each class names the part that refuses to go on."""


class LodestrataError(Exception):
    """Any of the below."""


class CheckpointError(LodestrataError, ValueError):
    """Stored page positions can't be used by the scan at hand."""


class StoreError(LodestrataError):
    """Files of a store or backup differ from what their manifest lists, or another writer was first."""


class SyncError(LodestrataError):
    """A run was sent, but the receiver hasn't all of it."""
