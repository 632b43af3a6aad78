"""Axiom text source, functional syntax.

Reads a file or a folder of files with ``spark.read.text``. A line that is a whole statement is cut into its parts by a
single regular expression (JVM-side, no UDF) if it starts with one of the three keywords the miner uses:

* ``ObjectPropertyAssertion(p s o)``  -> a fact,
* ``ObjectPropertyDomain(p C)`` / ``ObjectPropertyRange(p C)`` -> a declaration,
  where ``C`` is a class or an ``ObjectUnionOf(...)`` expression.

A statement may be broken over several lines. Runs of consecutive lines that are no whole statement are joined again by the task that
reads them, in Arrow batches: a statement starts at a line with a keyword and goes on until the next. Lines are never exchanged, only the joined
runs, so that one that goes on in the file's next split meets its end.

Names are full IRIs (``<...>``), prefixed names (``:a``, ``ex:a``) declared by ``Prefix(...)`` lines of
the same file, or, as individuals, blank nodes (``_:a``, kept as they are). Files may declare a prefix differently; a file that
declares none takes the prefixes on which all others agree, so a document may be written in parts. A statement of
these kinds that does not have this form (annotations, other class expressions, an undeclared
prefix, a missing parenthesis) gets the axiom type ``Malformed<kind>`` with null arguments: ``malformed`` counts them by file,
and none becomes a fact or a declaration. Other statements keep their keyword as ``axiom_type``. Manchester syntax
and OWL/XML are not supported (``ValueError``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.sizing import PARTS, fits, materialize_small
from ..functions.text import NAMESPACE, iri_col

# Axiom kinds and the syntax names accepted.
ASSERTION = "ObjectPropertyAssertion"
DOMAIN = "ObjectPropertyDomain"
RANGE = "ObjectPropertyRange"
SYNTAXES = ("functional", "fun")

MALFORMED = "Malformed"

# possessive: none of these parts can give back a character that the next one takes
_IRI = r"<[^<>\s]*+>"
_NAME = r"<[^<>\s]*+>|[A-Za-z][\w.-]*+:[\w.-]*+|:[\w.-]++"
_BLANK = r"_:[\w.-]++"
_KINDS = f"{ASSERTION}|{DOMAIN}|{RANGE}"
# kind, property, first argument, second argument; one pass, parts separated by a character no line holds
AXIOM_RE = (rf"^\s*+({_KINDS})\(\s*+({_NAME})\s++({_NAME}|{_BLANK}|ObjectUnionOf\([^()]*+\))"
            rf"(?:\s++({_NAME}|{_BLANK}))?\s*+\)\s*+$")
SEP = "\n"
PREFIX_RE = rf"^\s*Prefix\(\s*([A-Za-z]?[\w.-]*:)\s*=\s*({_IRI})\s*\)\s*$"
KEYWORD_RE = r"^\s*([A-Za-z]+)\s*\("
START_RE = r"^\s*(?!Object(?:UnionOf|IntersectionOf|ComplementOf|InverseOf|SomeValuesFrom|AllValuesFrom|OneOf)\b)[A-Za-z]+\s*\("  # not an expression


def dataset_name(path: str) -> str:
    """Base name of the input path, cut at ``.owl``."""
    base = path.rstrip("/").split("/")[-1]
    return base.split(".owl")[0]


def _placed(lines: DataFrame) -> DataFrame:
    """``lines`` with their ``file``, ``block`` (split of the file) and number ``nr`` in it."""
    out = lines
    for c, kind in (("file", "string"), ("block", "bigint")):
        if c not in out.columns:
            out = out.withColumn(c, F.lit("" if kind == "string" else 0).cast(kind))
    return out.select("value", "file", "block", F.monotonically_increasing_id().alias("nr"))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Columns computed once for each row: a generator of one row, which the optimiser does not repeat."""
    return df.select(F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def _cut(value: Column) -> Column:
    """Kind, property and arguments of a statement the miner uses; one part only if it is none."""
    return F.split(F.regexp_replace(value, AXIOM_RE, f"$1{SEP}$2{SEP}$3{SEP}$4"), SEP)


def _counts(value: Column) -> tuple[Column, Column]:
    """Parentheses opened and closed; those inside of IRIs do not count."""
    bare = F.regexp_replace(value, _IRI, "<>")
    return tuple(F.length(bare) - F.length(F.replace(bare, F.lit(x))) for x in "()")


def _marked(lines: DataFrame) -> DataFrame:
    """Placed lines with ``cut``, one regular expression a line, and ``whole``: whether a line is a statement of its own. One that is cut into
    its four parts is; parentheses are counted in the few others."""
    opens, closes = _counts(F.col("value"))
    out = once(_placed(lines), value=F.col("value"), file=F.col("file"), block=F.col("block"), nr=F.col("nr"), cut=_cut(F.col("value")))
    return out.withColumn("whole", F.when(F.size("cut") == 4, True).otherwise(F.col("value").rlike(START_RE) & (opens == closes)))


def _prefix_columns() -> tuple[Column, Column]:
    line = F.ltrim("value").startswith("Prefix")
    return tuple(F.when(line, F.regexp_extract("value", PREFIX_RE, i)) for i in (1, 2))


def prefixes(lines: DataFrame) -> DataFrame:
    """``(file, prefix, iri)`` of the ``Prefix(...)`` lines: ontology headers, a handful of rows for each file."""
    prefix, name = _prefix_columns()
    p = _placed(lines).where(F.ltrim("value").startswith("Prefix")).select("file", prefix.alias("prefix"), name.alias("iri"))
    return p.where("iri <> ''").groupBy("file", "prefix").agg(F.min("iri").alias("iri"))


def survey(lines: DataFrame) -> DataFrame:
    """``(file, prefix, iri)`` as ``prefixes``, and a row without a prefix for each file with lines that are no whole statement; one scan."""
    prefix, name = _prefix_columns()
    p = _marked(lines).where(F.size("cut") != 4).select(
        "file", F.col("whole").alias("_whole"), F.inline(F.array(F.struct(prefix.alias("prefix"), name.alias("iri")), F.struct(
            F.lit(None).cast("string").alias("prefix"), F.lit(None).cast("string").alias("iri")))))
    p = p.where("CASE WHEN prefix IS NULL THEN iri IS NULL AND NOT _whole ELSE iri <> '' END")
    # the least of a set of few IRIs: the minimum of a text would sort all broken lines
    return p.groupBy("file", "prefix").agg(F.array_min(F.collect_set("iri")).alias("iri"))


RUN_BITS = 12  # lines that one group of runs away from the edges covers, as a power of two


def _runs():
    """Arrow batches of a task's lines that are no whole statement -> its runs: lines of one split that follow each other, from one with a
    keyword (``starts``) to before the next, joined by blanks. ``edge`` tells a run that may be part of a statement of a neighbouring split: the last of its split, and
    the first one if it starts with no keyword. Only the run that may go on in the next batch is held."""
    def run(batches):  # travels by value: workers need not import this package
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def made(t, fresh_next):
            at = np.flatnonzero(t["first"].to_numpy())
            fresh, starts = t["fresh"].to_numpy()[at], t["starts"].to_numpy()[at]
            lists = pa.ListArray.from_arrays(np.append(at, t.num_rows).astype(np.int32), pa.concat_arrays(t["value"].chunks))
            heads = t.select(["file", "block", "nr", "starts"]).take(at)
            out = pa.table({"value": pc.binary_join(lists, " "), **{c: heads[c] for c in heads.column_names},
                            "edge": (fresh & ~starts) | np.append(fresh[1:], fresh_next)})
            return out.combine_chunks().to_batches()

        held, last = [], None  # tables of the run that may go on; file, block and number of the line before
        for b in batches:
            if b.num_rows == 0:
                continue
            file = b["file"].dictionary_encode()
            codes, block, nr = file.indices.to_numpy(), b["block"].to_numpy(), b["nr"].to_numpy()
            here = file.dictionary[int(codes[0])].as_py(), int(block[0])
            fresh = np.append(last is None or here != last[:2], (codes[1:] != codes[:-1]) | (block[1:] != block[:-1]))
            gap = np.append(last is None or nr[0] != last[2] + 1, nr[1:] != nr[:-1] + 1)
            first = fresh | gap | b["starts"].to_numpy(zero_copy_only=False)
            last = file.dictionary[int(codes[-1])].as_py(), int(block[-1]), int(nr[-1])
            t = pa.Table.from_batches([b]).append_column("fresh", pa.array(fresh)).append_column("first", pa.array(first))
            if first.any():
                k = int(np.flatnonzero(first)[-1])
                before = pa.concat_tables([*held, t.slice(0, k)])
                if before.num_rows:
                    yield from made(before, bool(fresh[k]))
                held = [t.slice(k)]
            else:
                held.append(t)
        if held:
            yield from made(pa.concat_tables(held), True)

    return run


def statements(lines: DataFrame, broken: bool = True) -> DataFrame:
    """``(value, file, cut)``: whole statements and their parts, those broken over several lines joined by blanks (``broken`` False says that
    there are none, so lines are read once)."""
    lines = _marked(lines)
    whole = lines.where("whole").select("value", "file", "cut")
    if not broken:
        return whole
    opens, closes = _counts(F.col("value"))
    rest = lines.where(~F.col("whole")).select("value", "file", "block", "nr", F.col("value").rlike(START_RE).alias("starts"))
    runs = rest.mapInArrow(_runs(), "value string, file string, block bigint, nr bigint, starts boolean, edge boolean")
    # runs at the edges of a file's splits meet in their order, the others are statements: these are dealt in small groups of their task
    group = F.when(F.col("edge"), F.lit(-1).cast("bigint")).otherwise(F.shiftright("nr", RUN_BITS))
    own = Window.partitionBy("file", "group").orderBy("block", "nr")
    runs = runs.withColumn("group", group).withColumn("open", F.col("edge") & (opens > closes))
    # the first run of a split that starts with no keyword ends the last statement of the split before, if that is open
    first = F.coalesce(F.lag("block").over(own) != F.col("block"), F.lit(True))
    goes_on = F.col("edge") & ~F.col("starts") & first & F.coalesce(F.lag("open").over(own), F.lit(False))
    runs = runs.withColumn("goes_on", goes_on)
    after = F.when(F.lead("goes_on").over(own), F.lead("value").over(own))
    joined = runs.select("file", F.when(~F.col("goes_on"), F.col("value")).alias("value"), after.alias("after"))
    joined = joined.where("value IS NOT NULL OR after IS NOT NULL").select("file", F.concat_ws(" ", "value", "after").alias("value"))
    # the parenthesis that closes the ontology may follow the last statement
    joined = joined.withColumn("value", F.when(closes == opens + 1, F.regexp_replace("value", r"\)\s*$", "")).otherwise(F.col("value")))
    joined = joined.where(F.trim("value") != "")
    return whole.unionByName(once(joined, value=F.col("value"), file=F.col("file"), cut=_cut(F.col("value"))))


def _full(c: Column, known: Column) -> Column:
    """A name as a full IRI by the prefixes ``known``; null when its prefix is not declared. Blank nodes stay."""
    end = F.instr(c, ":")
    whole = F.concat(F.try_element_at(known, F.substring(c, F.lit(1), end)), F.substring(c, end + 1, F.length(c)), F.lit(">"))
    return F.when(c.startswith("<") | c.startswith("_:") | c.startswith("ObjectUnionOf("), c).otherwise(whole)


def parse_axioms(lines: DataFrame) -> DataFrame:
    """``lines(value[, file, block])`` -> ``axioms(axiom_type, property, arg1, arg2, file)``."""
    found = materialize_small(survey(lines))
    broken = not found.where("prefix IS NULL").isEmpty()
    # the prefixes of a file (IRIs without the closing bracket): by broadcast when they are few, else the lines of a file meet them in parts
    open_iri = F.substring("iri", F.lit(1), F.length("iri") - 1)
    known = found.where("prefix IS NOT NULL").groupBy(F.col("file").alias("_file")).agg(
        F.map_from_entries(F.collect_list(F.struct("prefix", open_iri.alias("iri")))).alias("known"))
    p = statements(lines, broken)
    if fits(known):
        p = p.join(F.broadcast(known), F.col("file") == F.col("_file"), "left")
    else:
        copies = known.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        p = p.withColumn("_part", F.pmod(F.xxhash64("value"), F.lit(PARTS)).cast("int"))
        p = p.join(copies, (F.col("file") == F.col("_file")) & (F.col("_part") == F.col("_copy")), "left")
    # a file without any Prefix line (a part of a document written in parts) takes those on which the files agree: a handful
    agreed = (found.where("prefix IS NOT NULL").groupBy("prefix").agg(F.min(open_iri).alias("iri"), F.max(open_iri).alias("hi")).where("iri = hi")
              .select("prefix", "iri").collect())
    shared = F.map_from_arrays(F.array(*[F.lit(r["prefix"]) for r in agreed]).cast("array<string>"),
                               F.array(*[F.lit(r["iri"]) for r in agreed]).cast("array<string>"))
    known, fit = F.coalesce("known", shared), F.size("cut") == 4
    part = lambda i: F.get("cut", i)
    p = once(p, kind=F.when(fit, part(0)).otherwise(F.regexp_extract("value", KEYWORD_RE, 1)), file=F.col("file"), fits=fit,
             property=F.when(fit, _full(part(1), known)), arg1=F.when(fit, _full(part(2), known)),
             arg2=F.when(fit & (part(3) != ""), _full(part(3), known)))
    is_fact = F.col("kind") == ASSERTION
    ours = F.col("kind").isin(ASSERTION, DOMAIN, RANGE)
    good = F.coalesce(
        F.col("fits") & F.col("property").isNotNull() & F.col("arg1").isNotNull() & (is_fact == F.col("arg2").isNotNull())
        & ~F.when(is_fact, F.col("arg1").startswith("ObjectUnionOf(")).otherwise(F.col("arg1").startswith("_:")), F.lit(False))
    p = p.withColumn("good", good)
    name = (F.when(ours & ~F.col("good"), F.concat(F.lit(MALFORMED), "kind"))
            .when(F.col("kind") == "", F.lit("Other")).otherwise(F.col("kind")))
    return p.select(name.alias("axiom_type"), *[F.when(F.col("good"), F.col(c)).alias(c) for c in ("property", "arg1", "arg2")], "file")


def heads(axioms: DataFrame) -> DataFrame:
    """What schema and sizes read of axioms: kind, property, the class of a declaration; a fact's individuals are left empty, so rows that are
    kept take a few bytes each."""
    declared = F.col("axiom_type").isin(DOMAIN, RANGE)
    return axioms.where(declared | (F.col("axiom_type") == ASSERTION)).select(
        "axiom_type", "property", F.when(declared, F.col("arg1")).otherwise("").alias("arg1"), F.lit("").alias("arg2"))


def read_axioms(spark: SparkSession, path: str, syntax: str = "functional") -> DataFrame:
    """A1/A2: axioms of a functional-syntax file (or directory of files)."""
    if syntax not in SYNTAXES:
        raise ValueError(f"axioms are read in functional syntax only, not {syntax!r}; accepted names: {', '.join(SYNTAXES)}")
    return parse_axioms(spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")))


def malformed(axioms: DataFrame) -> DataFrame:
    """``(file, axiom_type, n)``: statements of the three kinds that could not be read."""
    return axioms.where(F.col("axiom_type").startswith(MALFORMED)).groupBy("file", "axiom_type").agg(F.count(F.lit(1)).alias("n"))


def assertions(axioms: DataFrame) -> DataFrame:
    """Facts ``(property, subject, object)`` from assertion axioms (a bag)."""
    return (axioms.where(F.col("axiom_type") == ASSERTION)
            .select("property", F.col("arg1").alias("subject"), F.col("arg2").alias("object")))


def declarations(axioms: DataFrame) -> DataFrame:
    """B2: domain or range axioms ``(axiom_type, property, cls)``."""
    return (axioms.where(F.col("axiom_type").isin(DOMAIN, RANGE))
            .select("axiom_type", "property", F.col("arg1").alias("cls")))


def domains(axioms: DataFrame) -> DataFrame:
    """``(property, cls)`` of domain axioms."""
    return declarations(axioms).where(F.col("axiom_type") == DOMAIN).select("property", "cls")


def ranges(axioms: DataFrame) -> DataFrame:
    """``(property, cls)`` of range axioms."""
    return declarations(axioms).where(F.col("axiom_type") == RANGE).select("property", "cls")


PLAIN = r"^[A-Za-z0-9_.-]+$"  # local names that may stand behind a prefix


def _as_iri(c: str, mixed: bool) -> Column:
    """An individual as text; ``mixed`` by the length of its name: in full, prefixed, or as a blank node."""
    col = F.col(c)
    whole = F.when(col.startswith("<"), col).otherwise(iri_col(col))
    if not mixed:
        return whole
    plain, form = col.rlike(PLAIN), F.length(col) % 3
    return (F.when((form != 0) & plain, F.concat(F.when(form == 1, F.lit(":")).otherwise(F.lit("_:")), col))
            .otherwise(whole))


def render_axioms(facts: DataFrame, decls: DataFrame, mixed: bool = False) -> DataFrame:
    """Functional-syntax text ``(value)`` of facts and ``decls(axiom_type, property, cls)``.

    Individuals that are not IRIs yet are put in the graph namespace. ``mixed`` writes them in all three forms of
    names and adds the ``Prefix`` line that they need.
    """
    fact_lines = facts.select(F.concat(
        F.lit(ASSERTION + "("), F.col("property"), F.lit(" "), _as_iri("subject", mixed), F.lit(" "),
        _as_iri("object", mixed), F.lit(")")).alias("value"))
    decl_lines = decls.select(F.concat(
        F.col("axiom_type"), F.lit("("), F.col("property"), F.lit(" "), F.col("cls"),
        F.lit(")")).alias("value"))
    out = fact_lines.unionByName(decl_lines)
    return out.unionByName(out.sparkSession.createDataFrame([(f"Prefix(:=<{NAMESPACE}>)",)], "value string")) if mixed else out
