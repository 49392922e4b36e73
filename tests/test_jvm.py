from gristmill.operators.jvm import jvm_flags


def test_flags_of_each_language_and_of_odd_sources(spark):
    rows = [
        ("a", "kotlin", "suspend inline fun x() {}\nobject {}\nlaunch { }"),
        ("b", "kotlin", "\n\n  object Store\n"),
        ("c", "kotlin", "\n" * 6 + "object Late"),
        ("d", "java", "/* x\n@Test */\npublic enum E {}\nprivate static E getInstance() {}"),
        ("e", "java", "suspend fun object flow { @Composable"),
        ("f", "go", "@Inject var x: Type"),
        ("g", "java", None),
        ("h", "kotlin", "public interface X /* open"),
        ("i", "kotlin", "// @Module\nclass A : B<Int>(x), c, D, B"),
    ]
    got = {r.file_path: r for r in jvm_flags(spark.createDataFrame(rows, "file_path string, language string, content string")).collect()}
    on = {k: {c for c, v in r.asDict().items() if v is True} for k, r in got.items()}
    assert on == {
        "a": {"is_suspend", "uses_coroutines"}, "b": {"is_singleton", "is_kotlin_object"}, "c": set(), "d": {"is_enum", "is_singleton_pattern"},
        "e": set(), "f": set(), "g": set(), "h": set(), "i": set(),
    }
    assert got["i"].inherits_from == ["B", "D"] and got["f"].injects == [] and got["g"].provides == []
