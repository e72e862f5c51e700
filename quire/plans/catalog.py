"""All queries of the library's own operators."""

from quire.plans import container_queries, page_queries, table_queries, text_queries
from quire.plans.registry import Registry

REGISTRY = Registry()
for part in (text_queries, table_queries, page_queries, container_queries):
    REGISTRY.plans |= part.REGISTRY.plans
    REGISTRY.sql |= part.REGISTRY.sql
