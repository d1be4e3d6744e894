import pytest

from tidemark.operators.listfield import protected_pattern, split_list_field, split_values

NAMES = ["Vock and Drab Grounding", "Glau / Glau Plus", "Bror, Field Set", "Zend (June; August)", "Plain"]
P = protected_pattern(NAMES)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (None, []), ("", []), ("  ", []), ("n/a", []), ("TBD", []), ("-", []),
        ("A, B,C ;D|E\nF\tG", list("ABCDEFG")), ("A，B、C", list("ABC")), ("A · B · C", list("ABC")),
        ("A / B / C", list("ABC")), ("A, B / C", ["A", "B / C"]), ("A/B, C", ["A/B", "C"]),
        ("A, B and C", list("ABC")), ("A, B, and C", list("ABC")), ("A and B", ["A", "B"]), ("A and B | C", ["A and B", "C"]),
        ("A, Vock and  Drab Grounding and B", ["A", "Vock and Drab Grounding", "B"]), ("X / glau / GLAU PLUS / Y", ["X", "glau / GLAU PLUS", "Y"]),
        ("Bror, Field Set, Bror, other", ["Bror, Field Set", "Bror", "other"]), ("A (x, y; z), B", ["A (x, y; z)", "B"]), ("Zend (June; August) (5-shot); B", ["Zend (June; August) (5-shot)", "B"]),
        ('"A","B, C"', ["A", "B, C"]), ('["A \\"q\\"", "b\\u00e9, c", "n/a"]', ['A "q"', "bé, c"]), ('"a ""x"" b", c', ['a "x" b', "c"]), ("'a, b', c", ["a, b", "c"]),
        ('5" disk, x', ['5" disk', "x"]), ("a (b, c", ["a (b", "c"]), ("• a\n• b\n - c", list("abc")), ("1. a\n2. b", ["a", "b"]), ("2. a\n7. b", ["2. a", "7. b"]),
        ("a,, b, ,c,", list("abc")), ("A\xa0B,  C  D ", ["A B", "C D"]), ("A, A", ["A", "A"]),
    ],
)
def test_values(text, want):
    assert split_values(text, P) == want


def test_long_text():
    assert len(split_values(", ".join(f"name {i}" for i in range(50_000)), P)) == 50_000
    assert split_values("(" * 3000 + "a, b") == ["(" * 3000 + "a", "b"]


def test_table(spark):
    rows = [(1, "A, B", "x"), (1, "A, B", "x"), (2, None, "x"), (3, "", "x"), (4, "Bror, Field Set; C", "x"), (None, "D, E", "x")]
    df = spark.createDataFrame(rows, "row_id bigint, field string, item_pos string").withColumnRenamed("field", "item_name")
    names = spark.createDataFrame([(n,) for n in [*NAMES, None]], "name string")
    want = {(1, 1, "A"), (1, 2, "B"), (4, 1, "Bror, Field Set"), (4, 2, "C"), (None, 1, "D"), (None, 2, "E")}
    for limit in (1000, 1):  # by one pattern, and by a join with the catalogue
        got = [tuple(r) for r in split_list_field(df, "row_id", "item_name", names, limit=limit).collect()]
        assert set(got) == want and len(got) == len(want)
    assert split_list_field(df.limit(0), "row_id", "item_name", names).count() == 0
    assert split_list_field(df, "row_id", "item_name", names.limit(0)).count() == 7


def test_long_names_of_a_large_catalogue(spark):
    """Beyond the limit names of any length are kept whole too, in rows without an id as well."""
    long = "Zorb of the very long and quite winding name, with a second part, and a third one (2024)"
    rows = [(1, f"A, {long.upper()}*, B"), (None, f"{long}; C"), (None, "D, Bror, Field Set"), (2, "[x, (Odd, Start) Set]"), (3, f"{long}: extra, E")]
    df = spark.createDataFrame(rows, "row_id bigint, field string")
    names = spark.createDataFrame([(n,) for n in [*NAMES, long, "(Odd, Start) Set"]], "name string")
    got = [sorted(map(repr, split_list_field(df, "row_id", "field", names, limit=limit).collect())) for limit in (1000, 1)]
    assert got[0] == got[1] and sum(long.lower() in x.lower() for x in got[1]) == 2 and sum("Bror, Field Set" in x for x in got[1]) == 1
