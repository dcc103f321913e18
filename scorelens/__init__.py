"""scorelens: classifier evaluation and evaluation-log analytics as Spark plans.

Everything here takes and returns DataFrames (or Columns); actions happen only in
sinks, streams and the few helpers that must materialise (checkpointed numbering).
"""

from scorelens.session import get_session, scratch_path

__all__ = ["get_session", "scratch_path"]
