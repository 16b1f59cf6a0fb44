"""Weekly panel analytics and probabilistic forecast evaluation on Spark."""

from panelcast.series import Series

__all__ = ["Series"]
__version__ = "0.1.0"
