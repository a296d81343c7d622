"""tessera — corpus preparation and PII redaction as Spark DataFrame jobs.

Every public operator is a function ``DataFrame -> DataFrame`` built from
Spark SQL expressions, joins, aggregates and windows, so Catalyst can prune,
push down and plan it. Python runs inside tasks for the model hook
(``operators.redact.redact_with``) and for dictionary lookups of measured size
(``operators.tokens``); ``tessera.llm`` is an optional part of its own.
"""

from tessera.session import get_session, shared_dir

__all__ = ["get_session", "shared_dir"]
