"""Case-control studies on linked health registries, as Spark DataFrame jobs."""

from caselink.config import StudyConfig
from caselink.session import build_session, tune

__all__ = ["StudyConfig", "build_session", "tune"]
