"""Flags of Kotlin and Java sources, from a table of rules, in built-in functions alone."""

from __future__ import annotations

from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

JVM = ("kotlin", "java")


class Rule(NamedTuple):
    """A flag holds in a source of one of the languages whose part `where` has any of the words.

    Parts: text (all without comments), head (its first HEAD characters), start (head begins so, spaces aside).
    """

    flag: str
    languages: tuple[str, ...]
    where: str
    words: tuple[str, ...]


# The size of a head, the words of every flag, and the patterns of types.
HEAD, OBJECT_LINES = 300, 5
RULES = (
    Rule("is_di_provider", JVM, "text", ("@Provides",)),
    Rule("is_di_consumer", JVM, "text", ("@Inject",)),
    Rule("is_suspend", ("kotlin",), "head", ("suspend fun ",)),
    Rule("is_suspend", ("kotlin",), "start", ("suspend ",)),
    Rule(
        "uses_coroutines", ("kotlin",), "text",
        ("launch", "async", "withContext", "runBlocking", "coroutineScope", "supervisorScope", "flow {", ".collect", "delay(", "awaitAll", "asFlow", "channelFlow", "callbackFlow"),
    ),
    Rule("uses_flow", ("kotlin",), "text", ("Flow<",)),
    Rule(
        "uses_async_java", ("java",), "text",
        ("CompletableFuture", "ExecutorService", "Executors.", "submit(", "supplyAsync", "runAsync", "thenApply", "thenCompose"),
    ),
    Rule("is_singleton", JVM, "text", ("@Singleton", "javax.inject.Singleton")),
    Rule("is_sealed", ("kotlin",), "head", ("sealed class ", "sealed interface ")),
    Rule("is_data_class", ("kotlin",), "head", ("data class ",)),
    Rule("is_abstract", JVM, "head", ("abstract class ",)),
    Rule("is_interface", ("kotlin",), "head", ("\ninterface ",)),
    Rule("is_interface", JVM, "start", ("interface ",)),
    Rule("is_interface", ("java",), "head", ("public interface ",)),
    Rule("is_enum", ("java",), "start", ("public enum ",)),
    Rule("is_enum", ("java",), "head", ("\npublic enum ", "\nenum ")),
    Rule("is_composable", ("kotlin",), "text", ("@Composable",)),
    Rule("is_di_component", ("kotlin",), "text", ("@Module", "@HiltViewModel", "@AndroidEntryPoint")),
    Rule("has_unit_test", ("java",), "text", ("@Test", "extends TestCase")),
)
#: A hand-made singleton in Java has all of these.
SINGLETON_PARTS = ("getInstance(", "private ", "static ")
TYPE_PATTERNS = {
    "provides": (r"@Provides[\s\S]*?fun\s+\w+\s*\([^)]*\)\s*:\s*([A-Z]\w+)", r"@Provides[\s\S]*?(?:public|protected|private)?\s+([A-Z]\w+)\s+\w+\s*\("),
    "injects": (r"@Inject\s+(?:lateinit\s+)?var\s+\w+\s*:\s*([A-Z]\w+)",),
}
CONSTRUCTOR, PARAMETER_TYPE = r"(?s)@Inject\s+constructor\s*\((.*?)\)", r":\s*([A-Z]\w+)"
KOTLIN_BASES = r"(?:^|\n)[^\n]*?(?:class|interface|object)\s+\w[\w<>]*?\s*(?:\([^)]*\))?\s*:\s*([^\{\n]+)"
JAVA_BASES = (r"\bextends\s+([A-Z]\w*(?:<[^>]*>)?)", r"\bimplements\s+([A-Z][\w,\s<>]*?)(?:\{|$)")


def without_comments(source: Column) -> Column:
    """The source without comments; one that spans lines leaves a line break, an open one ends the text."""
    inline = F.regexp_replace(source, r"/\*(?:(?!\*/)[^\n])*\*/", "")
    return F.regexp_replace(F.regexp_replace(inline, r"(?s)/\*.*?(?:\*/|\z)", "\n"), r"//[^\n]*", "")


def _types(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def _holds(rule: Rule) -> Column:
    part = {"text": F.col("_text"), "head": F.col("_head"), "start": F.regexp_replace("_head", r"^\s+", "")}[rule.where]
    test = F.startswith if rule.where == "start" else F.contains
    return F.col("language").isin(*rule.languages) & reduce(or_, (test(part, F.lit(w)) for w in rule.words))


def _bases() -> Column:
    listed = F.when(F.col("language") == "kotlin", F.regexp_extract("_head", KOTLIN_BASES, 1))
    java = F.concat_ws(",", *(F.nullif(F.regexp_extract("_head", p, 1), F.lit("")) for p in JAVA_BASES))
    # parts are cut at every comma first, inside type arguments too
    plain = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"<[^>]*>", ""), r"\([^)]*\)", ""))
    return F.array_distinct(F.filter(F.transform(F.split(listed.otherwise(java), ","), plain), lambda x: x.rlike(r"^[A-Z]\w*")))


def jvm_flags(files: DataFrame) -> DataFrame:
    """Flags, provided, injected and inherited types of sources (file_path, language, content); those in other languages have none."""
    parts = files.withColumn("_text", without_comments(F.coalesce("content", F.lit("")))).withColumn("_head", F.substring("_text", 1, HEAD))
    flags: dict[str, Column] = {}
    for rule in RULES:
        flags[rule.flag] = flags[rule.flag] | _holds(rule) if rule.flag in flags else _holds(rule)
    first_lines = F.slice(F.split("_text", "\n"), 1, OBJECT_LINES)
    flags["is_kotlin_object"] = (F.col("language") == "kotlin") & F.exists(first_lines, lambda line: line.rlike(r"^\s*object (?!\{)"))
    flags["is_singleton"] = flags["is_singleton"] | flags["is_kotlin_object"]
    flags["is_singleton_pattern"] = (F.col("language") == "java") & reduce(lambda a, b: a & b, (F.contains("_text", F.lit(w)) for w in SINGLETON_PARTS))
    inside = F.array_join(_types(F.col("_text"), CONSTRUCTOR), "\n")
    listed = {name: F.concat(*(_types(F.col("_text"), p) for p in patterns)) for name, patterns in TYPE_PATTERNS.items()}
    listed["injects"] = F.concat(listed["injects"], _types(inside, PARAMETER_TYPE))
    known = lambda types: F.when(F.col("language").isin(*JVM), types).otherwise(F.array().cast("array<string>"))
    types = {name: known(F.array_sort(F.array_distinct(found))) for name, found in listed.items()}
    return parts.select(
        "file_path", "language", *(F.coalesce(c, F.lit(False)).alias(name) for name, c in flags.items()),
        *(c.alias(name) for name, c in types.items()), known(_bases()).alias("inherits_from"),
    )
