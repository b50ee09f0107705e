"""veritable: profile, chart, compare and explain any Spark DataFrame."""

from veritable.dataset import Dataset
from veritable.schema import ROW_ID
from veritable.session import build_session, scratch_path

__all__ = ["Dataset", "ROW_ID", "build_session", "scratch_path"]
