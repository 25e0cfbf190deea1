from . import flow, queries, records, recovery, streams, trading  # noqa: F401
