from plumbline.streaming.batches import map_batches
from plumbline.streaming.profile import keep_profile, keep_reservoir, profile_stream, run_profile, summary_of
from plumbline.streaming.versions import keep_state, latest_state

__all__ = ["keep_profile", "keep_reservoir", "keep_state", "latest_state", "map_batches", "profile_stream", "run_profile", "summary_of"]
