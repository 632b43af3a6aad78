"""hornbeam: Horn-rule mining over typed facts, as Spark DataFrame plans."""

from .plans.mine import candidate_rules, mine, score
from .sources.kg_tables import facts_from_tables, knowledge_graph, schema_from_tables

__all__ = ["candidate_rules", "facts_from_tables", "knowledge_graph", "mine", "schema_from_tables",
           "score"]
