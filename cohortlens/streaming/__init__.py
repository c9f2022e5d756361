from cohortlens.streaming.q1_stream import q1_bar_stream, review_stream, start_q1_bar_stream
from cohortlens.streaming.q2_stream import label_changes, q2_bar, review_events, start_q2_bar_stream, status_events

__all__ = [
    "label_changes",
    "q1_bar_stream",
    "q2_bar",
    "review_events",
    "review_stream",
    "start_q1_bar_stream",
    "start_q2_bar_stream",
    "status_events",
]
