"""Evidence about code: candidates and slices, their projections, tests, risks and metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fields of a compact slice, volatile response fields, and words that are no symbols or that mark a task.
SLICE_FIELDS = ("file_path", "name", "parent_name", "chunk_type", "language", "lines", "score", "token_estimate", "citation", "why_included", "repo", "depth")
VOLATILE_FIELDS = ("latency_ms", "retrieval_ms", "generation_ms", "symbol_inference_ms", "uptime_seconds", "updated_at", "ts")
NO_SYMBOLS = (
    "add", "after", "all", "always", "and", "another", "app", "around", "before", "being", "can", "case", "change", "checkout", "code", "complex", "created",
    "developers", "domain", "edit", "event", "evaluate", "exact", "feature", "files", "find", "flow", "for", "from", "fully", "handling", "into", "logic", "make",
    "minimal", "module", "needed", "public", "apis", "new", "not", "only", "order", "paid", "payment", "plan", "propose", "refactor", "report", "reset", "safe",
    "separate", "state", "still", "success", "successful", "tests", "the", "this", "tracking", "when", "without",
)
ARCHITECTURE_WORDS = ("architecture", "boundary", "boundaries", "dependencies", "dependency", "extract", "module", "modules", "move", "public", "refactor", "risks")
RISKS = (
    ("semantic", "Semantic fallback was used; verify embedding-only hits before editing."),
    ("untested", "No test slice was retrieved; locate analytics tests before editing."),
    ("boundary", "Module-boundary task; verify Gradle dependencies and DI providers before editing."),
)


def _given(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c != "", c)


def candidates(hits: DataFrame) -> DataFrame:
    """Context candidates of symbol hits: id, range, citation and reason; the label is name, signature, context or base name."""
    start = F.when(F.col("start_line") > 0, F.col("start_line")).otherwise(F.col("line"))
    end = F.when(F.col("end_line") > 0, F.col("end_line")).otherwise(F.col("line"))
    label = F.coalesce(_given("name"), _given("signature"), _given("context"), F.element_at(F.split("file_path", "/"), -1))
    lines = F.concat(start.cast("string"), F.lit("-"), end.cast("string"))
    return hits.select(
        F.concat(F.lit("ast:"), "file_path", F.lit(":"), start.cast("string"), F.lit(":"), label).alias("chunk_id"), "file_path", "name", F.lit("").alias("parent_name"),
        F.col("kind").alias("chunk_type"), F.regexp_extract("file_path", r"\.([^./]+)$", 1).alias("language"), start.alias("start_line"), end.alias("end_line"),
        lines.alias("lines"), "score", F.concat("file_path", F.lit(":"), lines, F.lit(" ("), label, F.lit(")")).alias("citation"), F.concat(F.lit("ast_index_"), "source").alias("why_included"),
    )


def compact_slices(slices: DataFrame) -> DataFrame:
    """The stable fields that slices have; chunk_type and token_estimate have defaults."""
    for name, default in (("chunk_type", ""), ("token_estimate", 0)):
        slices = slices.withColumn(name, F.coalesce(F.col(name), F.lit(default)) if name in slices.columns else F.lit(default))
    return slices.select(*[c for c in SLICE_FIELDS if c in slices.columns])


def without_volatile(responses: DataFrame) -> DataFrame:
    return responses.drop(*VOLATILE_FIELDS)


def symbol_candidates(text: Column, limit: int = 12) -> Column:
    """Distinct identifiers with an upper-case letter or an underscore, in order of appearance."""
    found = F.regexp_extract_all(text, F.lit(r"([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1))
    code = F.filter(found, lambda w: w.rlike("[A-Z_]") & ~F.lower(w).isin(*NO_SYMBOLS))
    return F.slice(F.array_distinct(code), 1, limit)


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9_]+)"), F.lit(1))


def has_word(text: Column, words: Sequence[str]) -> Column:
    return F.arrays_overlap(_words(text), F.array(*map(F.lit, words)))


def needs_semantic(slices: DataFrame, keys: Sequence[str], least: int) -> DataFrame:
    """(keys, semantic): whether exact evidence is thin or none of it has exact or AST provenance."""
    exact = F.col("why_included").startswith("ast_index") | (F.col("why_included") == "exact_or_lexical_match")
    return slices.groupBy(*keys).agg(((F.count("*") < least) | ~F.coalesce(F.bool_or(exact), F.lit(False))).alias("semantic"))


def collect_tests(slices: DataFrame, is_test: Column, order: Sequence[str], limit: int) -> DataFrame:
    """The first test slices, one for each path, range and name."""
    one = Window.partitionBy("file_path", "lines", "name").orderBy(*order)
    return slices.where(is_test).withColumn("_n", F.row_number().over(one)).where("_n = 1").drop("_n").orderBy(*order).limit(limit)


def risks(text: Column, semantic: Column, ambiguous: Column, n_tests: Column) -> Column:
    """Messages about a task and its evidence; ambiguous is an array of names."""
    said, low = dict(RISKS), F.lower(text)
    names = F.array_join(F.slice(ambiguous, 1, 3), ", ")
    about = lambda *words: F.greatest(*(F.contains(low, F.lit(w)) for w in words))
    return F.array_compact(
        F.array(
            F.when(semantic, said["semantic"]),
            F.when(F.size(ambiguous) > 0, F.concat(F.lit("Same-name symbols need caller/path disambiguation: "), names, F.lit("."))),
            F.when(about("analytics", "event") & (n_tests == 0), said["untested"]),
            F.when(about("module", "dependency", "extract", "move"), said["boundary"]),
        )
    )


def eval_metrics(slices: DataFrame, first: DataFrame, key: str) -> DataFrame:
    """(key, first_relevant_rank, embeddings_used, source_tokens): rank of the stated first slice, 1 if it isn't among them."""
    marked = slices.join(first.withColumn("_first", F.lit(True)), [key, "file_path"], "left")
    return marked.groupBy(key).agg(
        F.coalesce(F.min(F.when(F.col("_first"), F.col("rank"))), F.lit(1)).alias("first_relevant_rank"),
        F.bool_or(F.col("why_included") == "semantic_match").alias("embeddings_used"), F.sum("token_estimate").alias("source_tokens"),
    )


def first_hit(*sources: Column) -> Column:
    """The first path of the first of several ordered path arrays that has one."""
    return F.coalesce(*(F.get(s, 0) for s in sources))


def ask_context(hits: DataFrame, keys: Sequence[str], order: Sequence[str | Column], most_chars: int = 1200) -> DataFrame:
    """(keys, context): numbered citations, each with its code cut to 200 to 4,000 characters."""
    most = max(200, min(4000, most_chars))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    head = F.concat(F.lit("["), "n", F.lit("] "), "file_path", F.lit(":"), "start_line", F.lit("-"), "end_line", F.lit(" ("), F.coalesce(_given("name"), F.col("parent_name")), F.lit(")\n```\n"))
    block = F.concat(head, F.substring("code", 1, most), F.lit("\n```"))
    blocks = hits.withColumn("n", number).select(*keys, F.col("n").alias("_n"), block.alias("_b"))
    return blocks.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_b"))), lambda x: x["_b"]), "\n\n").alias("context"))


def parse_call_tree(lines: DataFrame, line: str = "line") -> DataFrame:
    """Rows `name (path:line)` of an indented call tree, with depth and a score that falls with it."""
    pattern = r"^(\s*)([A-Za-z_][A-Za-z0-9_.<>]*)\s+\((.+):(\d+)\)"
    part = lambda i: F.regexp_extract(line, pattern, i)
    depth = F.expr("CAST(length(indent) div 2 AS BIGINT)")
    rows = lines.where(F.col(line).rlike(pattern)).select("*", part(1).alias("indent"), part(2).alias("name"), F.trim(part(3)).alias("file_path"), part(4).cast("long").alias("at"))
    return rows.withColumn("depth", depth).withColumn("score", F.greatest(F.lit(0), 10 - F.col("depth")).cast("double")).drop("indent")


HIT = "path string, file_path string, line long, start_line long, end_line long, name string, kind string, type string, signature string, context string, code string, score double"


def parse_json_hits(rows: DataFrame, text: str, source: str) -> DataFrame:
    """Hits of JSON arrays under any of their field names; hits without a path go."""
    hit = rows.select(*[c for c in rows.columns if c != text], F.explode(F.from_json(text, f"array<struct<{HIT.replace(' ', ':')}>>".replace(",:", ","))).alias("h"))
    line = F.coalesce("h.line", "h.start_line", F.lit(1).cast("long"))
    blank = lambda c: F.coalesce(f"h.{c}", F.lit("")).alias(c)
    return hit.select(
        *[c for c in rows.columns if c != text], F.coalesce("h.path", "h.file_path").alias("file_path"), line.alias("line"), blank("name"), F.coalesce("h.kind", "h.type", F.lit(source)).alias("kind"),
        blank("signature"), blank("context"), blank("code"), F.coalesce("h.start_line", line).alias("start_line"), F.coalesce("h.end_line", line).alias("end_line"),
        F.coalesce("h.score", F.lit(0.0)).alias("score"), F.lit(source).alias("source"),
    ).where("file_path IS NOT NULL")


def context_header(path: Column, language: Column, parent: Column) -> Column:
    leader = F.when(language == "python", "#").otherwise("//")
    return F.concat_ws("\n", F.concat(leader, F.lit(" File: "), path), F.when(parent != "", F.concat(leader, F.lit(" Class: "), parent)), F.concat(leader, F.lit(" Language: "), language))


def has_unit_test(symbols: DataFrame, stems: DataFrame, name: str = "name", stem: str = "stem") -> DataFrame:
    """symbols with has_unit_test: whether some test stem holds test_<name> or <name>_test.

    The names that each stem can hold come from its own substrings at word ends, so this is an equality join.
    """
    low = F.lower(stem)
    after = F.explode(F.expr("filter(transform(sequence(1, greatest(length(s), 1)), i -> IF(substring(s, i, 5) = 'test_', i + 5, 0)), i -> i > 0 AND i <= length(s))"))
    upto = F.explode(F.expr("filter(transform(sequence(1, greatest(length(s), 1)), i -> IF(substring(s, i, 5) = '_test', i - 1, 0)), i -> i > 0)"))
    own = stems.select(low.alias("s")).distinct()
    right = own.select("s", after.alias("i")).select(F.explode(F.expr("transform(sequence(1, length(s) - i + 1), k -> substring(s, i, k))")).alias("covered"))
    left = own.select("s", upto.alias("i")).select(F.explode(F.expr("transform(sequence(1, i), k -> substring(s, k, i - k + 1))")).alias("covered"))
    covered = right.union(left).distinct().withColumn("_has", F.lit(True))
    marked = symbols.join(covered, F.lower(name) == F.col("covered"), "left")
    return marked.select(*symbols.columns, (F.coalesce("_has", F.lit(False)) & (F.col(name) != "")).alias("has_unit_test"))


def ast_graph(defs: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes, the last definition of each qualified name, and distinct edges with a source; implements counts as inherits."""
    last = Window.partitionBy("qualified").orderBy(F.desc("start_line"), F.desc("file_path"))
    nodes = defs.withColumn("_n", F.row_number().over(last)).where("_n = 1").select(F.col("qualified").alias("id"), "file_path", "name", "parent_name", F.col("kind").alias("chunk_type"))
    relation = F.when(F.col("relation") == "implements", "inherits").otherwise(F.col("relation"))
    return nodes, edges.where("from_name != ''").select(F.col("from_name").alias("from_node"), F.col("to_name").alias("to_node"), relation.alias("relation")).distinct()


def vocab_records(vocab: DataFrame, repo: str) -> DataFrame:
    """Vocabulary records of (file, summary): name is the stem, language the extension."""
    base = F.element_at(F.split("file", "/"), -1)
    return vocab.select(
        F.concat(F.lit(f"{repo}:vocab:"), "file").alias("id"), F.col("file").alias("file_path"), F.regexp_replace(base, r"(?<=.)\.[^.]*$", "").alias("name"),
        F.regexp_extract(base, r".\.([^.]+)$", 1).alias("language"), "summary", F.sha2(F.concat("file", F.lit(":"), "summary"), 256).alias("content_hash"),
    )
