"""The query catalogue, by workload."""

from fathom.plans import catalog, documents, durable, events, lifecycle, places, retrieval, upkeep

ALL = [retrieval, documents, catalog, events, lifecycle, upkeep, durable, places]
