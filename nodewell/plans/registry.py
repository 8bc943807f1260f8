"""All registered queries and their SQL."""

from nodewell.plans import model_runs, movement, quality, speech_text, stored

_MODULES = (model_runs, quality, movement, speech_text, stored)
QUERIES = {f.__name__: f for m in _MODULES for f in m.QUERIES}
ORACLE: dict[str, str] = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
