"""Micro-batch scoring with Structured Streaming and an append-only tracker."""

from scorelens.streaming.microbatch import IMAGE_SCHEMA, produce_micro_batches
from scorelens.streaming.scoring import run_scoring_stream, score_micro_batch
from scorelens.streaming.tracker import tracker_view

__all__ = ["IMAGE_SCHEMA", "produce_micro_batches", "run_scoring_stream", "score_micro_batch", "tracker_view"]
