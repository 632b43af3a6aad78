"""Named queries over the table-derived knowledge graph (one per inventory group).

Every query reads the whole test tables through ``facts_from_tables``; outputs
use flat columns (arrays are joined into sorted strings) so they can be compared
with the SQL in ``oracle_sql``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sizing import materialize_small
from ..functions.text import iri, iri_col, local_name
from ..operators import facts as fx
from ..operators.candidates import atom_pairs, classify, connected_triples, open_paths
from ..operators.clusters import all_clusters, cluster_properties, similar_pairs
from ..operators.rules import apply_thresholds, dedupe, render, with_atom_text
from ..operators.schema import class_overlap, property_schema, schema_report
from ..sources import axioms as ax
from ..sources import store
from ..sources.kg_tables import declarations_from_tables, knowledge_graph
from .mine import candidate_rules, mine, score, score_candidates, score_made

SCORE_COLUMNS = ["head", "body1", "body2", "support", "body_size", "head_size", "conf",
                 "head_coverage"]
Query = Callable[[SparkSession, str], DataFrame]


def _with_facts(facts: DataFrame) -> DataFrame:
    return fx.property_sizes(facts).select("property")


def _typed(schema: DataFrame, sizes: DataFrame) -> DataFrame:
    return schema.join(sizes, "property", "leftsemi")


def _typed_with_facts(facts: DataFrame, schema: DataFrame) -> DataFrame:
    return _typed(schema, materialize_small(_with_facts(facts)))


def _axiom_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All facts and declarations as text, individuals in all three forms of names."""
    facts, _ = knowledge_graph(spark, sf_dir)
    return ax.render_axioms(facts, declarations_from_tables(spark), mixed=True)


FILE_LINES = 100_000  # lines of one compressed text file


def _axiom_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same text written below the shared folder and read as files: compressed, so each is read by one task and holds at most ``FILE_LINES``."""
    path = store.store_path(spark, "axioms", unique=True)
    _axiom_text(spark, sf_dir).write.option("maxRecordsPerFile", FILE_LINES).text(path, compression="snappy")
    return ax.read_axioms(spark, path, "functional")


def _flat_clusters(c: DataFrame) -> DataFrame:
    return c.select("kind", "cluster_id", F.concat_ws(",", "properties").alias("members"),
                    F.size("properties").cast("bigint").alias("n_members"))


def _scored(df: DataFrame, columns: list[str] = SCORE_COLUMNS) -> DataFrame:
    """Counts as text: supports of joins outgrow 64 bits, and text compares alike everywhere."""
    return df.select(*[F.col(c).cast("string").alias(c) if c in ("support", "body_size") else c for c in columns])


# ---------------------------------------------------------------- sources, schema

def q_axioms_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Render every fact as functional-syntax text and tokenise it back."""
    return ax.assertions(ax.parse_axioms(_axiom_text(spark, sf_dir)))


def _of_heads(axioms: DataFrame, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A small table (of properties or declarations) made from ``axioms`` without their individuals; the text is parsed once, whatever ``make`` reads."""
    kept = ax.heads(axioms).persist(StorageLevel.MEMORY_AND_DISK)
    out = materialize_small(make(kept))
    kept.unpersist()
    return out


def q_domain_range_axioms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain / range axioms found in the whole axiom text, with the facts of each property."""
    return _of_heads(ax.parse_axioms(_axiom_text(spark, sf_dir)), lambda axioms: _with_fact_count(ax.declarations(axioms), axioms))


def _with_fact_count(declared: DataFrame, axioms: DataFrame) -> DataFrame:
    n = fx.property_sizes(ax.assertions(axioms)).withColumnRenamed("n", "n_facts")
    return declared.join(n, "property", "left").withColumn("n_facts", F.coalesce("n_facts", F.lit(0).cast("bigint")))


def q_property_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed schema parsed from the text, with the fact count of each property."""
    def made(axioms: DataFrame) -> DataFrame:
        sch = property_schema(ax.domains(axioms), ax.ranges(axioms))
        return sch.join(fx.property_sizes(ax.assertions(axioms)), "property")
    return _of_heads(ax.parse_axioms(_axiom_text(spark, sf_dir)), made)


def q_schema_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every declared property with its facts, kept / dropped and the reason."""
    def made(axioms: DataFrame) -> DataFrame:
        rep = schema_report(ax.domains(axioms), ax.ranges(axioms))
        rep = rep.select("property", "name", F.col("n_classes").cast("bigint").alias("n_classes"), "kept", "reason")
        return _with_fact_count(rep, axioms)
    return _of_heads(ax.parse_axioms(_axiom_text(spark, sf_dir)), made)


# ---------------------------------------------------------------- facts

def q_vertical_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts, _ = knowledge_graph(spark, sf_dir)
    return fx.vertical_partition(facts)


def q_property_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts, _ = knowledge_graph(spark, sf_dir)
    return fx.property_sizes(facts)


def q_triple_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts, _ = knowledge_graph(spark, sf_dir)
    return fx.triple_sets(facts)


def q_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts, schema = knowledge_graph(spark, sf_dir)
    return fx.degrees(fx.sides(fx.fact_sets(fx.typed_facts(facts, schema))))


# ---------------------------------------------------------------- clusters, candidates

def _clusters_query(kind: str | None, method: str = "exact", **kw) -> Query:
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        facts, schema = knowledge_graph(spark, sf_dir)
        wf = _with_facts(facts)
        c = (all_clusters(schema, wf, method, **kw) if kind is None
             else cluster_properties(schema, wf, kind, method, **kw))
        out = _flat_clusters(c)
        return out.drop("cluster_id") if method != "exact" else out
    return q


def q_similar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts, schema = knowledge_graph(spark, sf_dir)
    typed = _typed_with_facts(facts, schema)
    out = None
    for kind in ("domain_range", "domain", "range"):
        p = similar_pairs(typed, kind)
        out = p if out is None else out.unionByName(p)
    return out


def q_candidates(atoms: int) -> Query:
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        facts, schema = knowledge_graph(spark, sf_dir)
        return candidate_rules(facts, schema, atoms)
    return q


def q_class_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts, schema = knowledge_graph(spark, sf_dir)
    pairs = atom_pairs(candidate_rules(facts, schema, 3))
    ov = class_overlap(pairs, schema)
    return ov.select("p", "q", F.concat_ws(",", F.transform("classes", local_name)).alias("classes"),
                     F.size("classes").cast("bigint").alias("n_classes"))


def q_candidates_classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts, schema = knowledge_graph(spark, sf_dir)
    c = classify(connected_triples(_typed_with_facts(facts, schema)).unionByName(
        candidate_rules(facts, schema, 3)).distinct(), schema)
    return c.select("head", "body1", "body2", "pattern_join", "pattern_binding")


# ---------------------------------------------------------------- join measure by pattern

def q_join_pattern(patterns: tuple[str, ...], star_side: str | None = None) -> Query:
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        facts, schema = knowledge_graph(spark, sf_dir)

        def made(sizes: DataFrame) -> DataFrame:
            sel = classify(connected_triples(_typed(schema, sizes)), schema).where(F.col("pattern_join").isin(*patterns))
            if star_side is not None:
                idx = 0 if star_side == "domain" else 1
                sel = sel.where(F.get("c12", 0) == F.get("d0", idx))
            return sel
        return _scored(score_made(facts, schema, made))
    return q


def q_join_two_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts, schema = knowledge_graph(spark, sf_dir)
    return _scored(score_candidates(facts, schema, 2))


def q_body_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts, schema = knowledge_graph(spark, sf_dir)
    s = score_candidates(facts, schema, 3)
    return _scored(s, ["head", "body1", "body2", "body_size"])


def q_disconnected_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules over open paths: bodies unconnected (S6, confidence 0) or head apart."""
    facts, schema = knowledge_graph(spark, sf_dir)
    s = score_made(facts, schema, lambda sizes: classify(open_paths(_typed(schema, sizes)), schema))
    return _scored(s, ["head", "body1", "body2", "pattern", "support", "body_size", "conf", "head_coverage"])


# Rules whose atoms are apart, as local names (head, body1, body2): bodies apart with one
# connected pair (both classes, one class, on either side), and no two atoms connected.
APART = [("did_view", "did_click", "customerIn"), ("did_view", "customerIn", "did_click"),
         ("customerIn", "supplierIn", "did_view"), ("customerIn", "did_view", "supplierIn"),
         ("did_view", "supplierIn", "inSegment"), ("inSegment", "did_error", "supplierIn")]


def _apart(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([tuple(iri(n) for n in r) for r in APART], "head string, body1 string, body2 string")


def q_apart(measure: str) -> Query:
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Rules with one connected pair (S6) or none (S8); under the binding measure no common class (M3d)."""
        facts, schema = knowledge_graph(spark, sf_dir)
        return _scored(score(facts, schema, _apart(spark), measure), ["pattern", *SCORE_COLUMNS])
    return q


# ---------------------------------------------------------------- binding measure by pattern

def q_binding_pattern(patterns: tuple[str, ...], one_object: bool = False) -> Query:
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        facts, schema = knowledge_graph(spark, sf_dir)

        def made(sizes: DataFrame) -> DataFrame:
            return classify(connected_triples(_typed(schema, sizes)), schema).where(F.col("pattern_binding").isin(*patterns))
        return _scored(score_made(facts, schema, made, "binding", one_object))
    return q


def q_binding_two_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts, schema = knowledge_graph(spark, sf_dir)
    return _scored(score_candidates(facts, schema, 2, "binding"))


def q_binding_one_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts, schema = knowledge_graph(spark, sf_dir)
    return _scored(score_candidates(facts, schema, 3, "binding", one_object_per_subject=True))


# ---------------------------------------------------------------- rules

def _scored_join3(spark: SparkSession, sf_dir: str):
    facts, schema = knowledge_graph(spark, sf_dir)
    return schema, score_candidates(facts, schema, 3)


def q_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, s = _scored_join3(spark, sf_dir)
    return apply_thresholds(s).select("head", "body1", "body2", "conf", "head_coverage")


def q_dedupe_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema, s = _scored_join3(spark, sf_dir)
    kept = apply_thresholds(s).withColumnRenamed("head_coverage", "fitness")
    return dedupe(with_atom_text(kept, schema)).select("head", "body1", "body2", "conf", "fitness")


def q_render_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema, s = _scored_join3(spark, sf_dir)
    kept = apply_thresholds(s).withColumnRenamed("head_coverage", "fitness")
    r = render(dedupe(with_atom_text(kept, schema)))
    return r.select("head", "body1", "body2", "rule")


def q_mine(atoms: int, measure: str) -> Query:
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        facts, schema = knowledge_graph(spark, sf_dir)
        return mine(facts, schema, atoms, measure)
    return q


def q_store_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the facts partitioned by property under the shared folder and read them back."""
    facts, _ = knowledge_graph(spark, sf_dir)
    path = store.store_path(spark, "facts", unique=True)
    return store.materialize(facts, path, mode="overwrite")


def q_mine_from_axioms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Axiom text to rules, the way a user starts: read a file, derive the schema, mine."""
    axioms = _axiom_file(spark, sf_dir)
    declared = materialize_small(ax.declarations(axioms)).withColumnRenamed("cls", "arg1")  # no facts are kept for it
    schema = materialize_small(property_schema(ax.domains(declared), ax.ranges(declared)))
    return mine(ax.assertions(axioms), schema, 3, "join")


FILE_FACTS = 1_000_000  # facts of one text file


def q_axioms_two_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts in two files that declare one prefix differently, every statement of the second broken over three
    lines, and a third file of broken statements (A1, B1, B4): facts per file, and its malformed statements. Beyond ``FILE_FACTS`` facts a
    file goes on in others that repeat its header, so no task writes it alone."""
    facts, _ = knowledge_graph(spark, sf_dir)
    path = store.store_path(spark, "axioms", unique=True)
    files = 1 + facts.count() // FILE_FACTS
    name = lambda c: F.when(F.col(c).rlike(ax.PLAIN), F.concat(F.lit(":"), c)).otherwise(iri_col(c))
    for folder, sep in (("a", " "), ("b", "\n   ")):
        line = F.concat(F.lit("ObjectPropertyAssertion(:"), local_name("property"), F.lit(sep), name("subject"), F.lit(sep), name("object"), F.lit(")"))
        # each part once and with its header; parts that meet in one file say the same header twice, so their order does not matter
        text = facts.where(F.length(F.concat("subject", "object")) % 2 == int(folder == "b")).select(
            F.pmod(F.xxhash64("subject", "object"), F.lit(files)).cast("int").alias("at"), line.alias("value"))
        head = spark.range(files).select(F.col("id").cast("int").alias("at"), F.lit(f"Prefix(:=<http://{folder}#>)").alias("value"))
        head.unionByName(text).repartition(files, "at").select("value").write.text(f"{path}/{folder}")
    broken = ["Prefix(:=<http://c#>)", "ObjectPropertyAssertion(:p :a", "ObjectPropertyAssertion(:p :a :b :c)", "ObjectPropertyDomain(x:p :A)"]
    spark.createDataFrame([(x,) for x in broken], "value string").coalesce(1).write.text(f"{path}/c")
    axioms = ax.read_axioms(spark, f"{path}/*", "functional")
    wrong = ax.malformed(axioms).select(F.col("axiom_type").alias("property"), "n")
    return fx.property_sizes(ax.assertions(axioms)).unionByName(wrong)


PRUNED = ["customerIn", "inSegment", "did_error"]  # properties of the pruned read


def q_store_pruned_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store of all facts, read for a few properties only: the others' directories are pruned (A4)."""
    facts, _ = knowledge_graph(spark, sf_dir)
    path = store.store_path(spark, "facts", unique=True)
    store.materialize(facts, path)
    return store.read_facts(spark, path, [iri(n) for n in PRUNED])


def stored_graph(spark: SparkSession, facts: DataFrame, schema: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """The typed properties' facts of a store and their bag sizes: directories are pruned before anything is cached, sizes come
    from the manifest."""
    store.materialize(facts, path, mode="reuse")
    names = [r["property"] for r in schema.select("property").collect()]  # schema-level
    return store.cache_facts(store.read_facts(spark, path, names)), store.stored_sizes(spark, path)


def q_mine_from_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mine from the stored facts (A5, A6, A8, N3): written once, verified and reused, read for the typed properties only."""
    facts, schema = knowledge_graph(spark, sf_dir)
    path = store.store_path(spark, ax.dataset_name(sf_dir), unique=True)
    store.materialize(facts, path)
    kept, sizes = stored_graph(spark, facts, schema, path)
    out = mine(kept, schema, 3, "join", sizes=sizes)
    kept.unpersist()
    return out


def q_store_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes from a store's manifest, and the properties in which it differs from the same facts said in distinct rows."""
    facts, _ = knowledge_graph(spark, sf_dir)
    path = store.store_path(spark, "facts", unique=True)
    store.materialize(facts, path)
    other = store.differences(facts.distinct(), path).select("property", F.col("n_here").alias("n_distinct"))
    return store.stored_sizes(spark, path).join(other, "property", "left")


def q_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named views joined in SQL by their class columns (A7): customers and suppliers of each nation."""
    facts, schema = knowledge_graph(spark, sf_dir)
    store.register_views(spark, facts, schema, "kg_")
    return spark.sql("""SELECT c.Nation AS nation, c.n AS customers, s.n AS suppliers
        FROM (SELECT Nation, count(DISTINCT Customer) AS n FROM kg_customerIn GROUP BY Nation) c
        JOIN (SELECT Nation, count(DISTINCT Supplier) AS n FROM kg_supplierIn GROUP BY Nation) s ON c.Nation = s.Nation""")


def q_partitioned_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts dealt by hash and by range of the property keep their sizes (H1, H2, H3)."""
    facts, _ = knowledge_graph(spark, sf_dir)
    out = None
    for name, df in (("hash", store.hash_partition(facts, 8, "property", "subject")), ("round", store.hash_partition(facts, 8)),
                     ("range", store.range_partition(facts, 8, "property", "subject"))):
        n = fx.property_sizes(df).withColumn("dealt", F.lit(name))
        out = n if out is None else out.unionByName(n)
    return out


QUERIES: dict[str, Query] = {
    "mine_from_axioms": q_mine_from_axioms,
    "mine_from_store": q_mine_from_store,
    "axioms_two_files": q_axioms_two_files,
    "store_pruned_read": q_store_pruned_read,
    "store_manifest": q_store_manifest,
    "views_join": q_views,
    "partitioned_sizes": q_partitioned_sizes,
    "join_apart": q_apart("join"),
    "binding_apart": q_apart("binding"),
    "axioms_roundtrip": q_axioms_roundtrip,
    "domain_range_axioms": q_domain_range_axioms,
    "property_schema": q_property_schema,
    "schema_drops_union_and_same_class": q_schema_drops,
    "vertical_partition": q_vertical_partition,
    "property_sizes": q_property_sizes,
    "triple_sets": q_triple_sets,
    "degrees": q_degrees,
    "clusters_domain": _clusters_query("domain"),
    "clusters_range": _clusters_query("range"),
    "clusters_domain_range": _clusters_query("domain_range"),
    "clusters_all": _clusters_query(None),
    "clusters_minhash": _clusters_query(None, "minhash", num_features=1 << 18),
    "clusters_minhash_20": _clusters_query(None, "signature"),
    "clusters_minhash_5": _clusters_query(None, "signature", num_features=5),
    "similar_pairs": q_similar_pairs,
    "class_overlap": q_class_overlap,
    "candidates_2": q_candidates(2),
    "candidates_3": q_candidates(3),
    "candidates_classified": q_candidates_classified,
    "join_two_atoms": q_join_two_atoms,
    "join_s1": q_join_pattern(("S1",)),
    "join_s2": q_join_pattern(("S2",)),
    "join_s3": q_join_pattern(("S3",)),
    "join_star_domain": q_join_pattern(("S4_star", "S5a"), "domain"),
    "join_star_range": q_join_pattern(("S4_star", "S5a"), "range"),
    "join_triangle": q_join_pattern(("S4_triangle",)),
    "join_s5a": q_join_pattern(("S5a",)),
    "join_s5b": q_join_pattern(("S5b",)),
    "body_size": q_body_size,
    "disconnected_rules": q_disconnected_rules,
    "binding_m1": q_binding_pattern(("M1",)),
    "binding_m2": q_binding_pattern(("M2",)),
    "binding_m3a": q_binding_pattern(("M3a",)),
    "binding_m3b": q_binding_pattern(("M3b",)),
    "binding_m3c": q_binding_pattern(("M3c",)),
    "binding_two_atoms": q_binding_two_atoms,
    "binding_one_object": q_binding_one_object,
    "thresholds": q_thresholds,
    "dedupe_rules": q_dedupe_rules,
    "render_rules": q_render_rules,
    "mine_join_2": q_mine(2, "join"),
    "mine_join_3": q_mine(3, "join"),
    "mine_binding_2": q_mine(2, "binding"),
    "mine_binding_3": q_mine(3, "binding"),
    "store_roundtrip": q_store_roundtrip,
}
