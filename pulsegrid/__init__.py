"""pulsegrid: event analysis of multi-channel recordings on Spark."""

from .plans.pipeline import Sorted, event_times, sort_blocks, sort_recording
from .session import checkpoint_folder, local_session
from .sources.recording import RecordingSource, read_recording

__all__ = [
    "RecordingSource",
    "Sorted",
    "checkpoint_folder",
    "event_times",
    "local_session",
    "read_recording",
    "sort_blocks",
    "sort_recording",
]
