import pytest

from millrace.operators import splitting


def twice(record):
    return [record, record | {"payload": record["payload"] + "!"}] if record["payload"] else []


def moved(record):
    return [record | {"stream": "other"}]


def test_splitters():
    split = splitting.paragraphs(12)
    assert list(split("# h\n\none\n\ntwo\n\nthree four five\n\n\n\nsix")) == [("heading", "# h"), ("text", "one\n\ntwo"), ("text", "three four five"), ("text", "six")]
    assert list(split("")) == [] and list(splitting.whole("")) == [("text", "")]
    assert [t for _, t in splitting.windows(4, 1)("abcdefgh")] == ["abcd", "defg", "gh"]
    assert [t for _, t in splitting.windows(4, 1)("")] == [""]
    for wrong in (lambda: splitting.windows(3, 3), lambda: splitting.paragraphs(0)):
        with pytest.raises(ValueError):
            wrong()


def test_split_keeps_columns_and_repeated_rows(spark, written):
    docs = written([(1, "abc", "x"), (1, "abc", "x"), (2, None, "y"), (3, "", "z")], "id int, text string, index string")
    got = splitting.split(docs, splitting.windows(2))
    assert got.columns == ["id", "index", "element_type", "text"]
    assert sorted((r.id, r["index"], r.text) for r in got.collect()) == [(1, 0, "ab"), (1, 0, "ab"), (1, 1, "c"), (1, 1, "c"), (3, 0, "")]
    assert splitting.split(docs.where("false"), splitting.whole).count() == 0


def test_sql(spark, written):
    written([(1, "a\n\nb"), (2, None)], "id int, text string").createOrReplaceTempView("texts_to_split")
    splitting.register(spark, "split_paragraphs", splitting.paragraphs(1))
    rows = spark.sql("select id, p.text from texts_to_split, lateral split_paragraphs(text) p order by all").collect()
    assert [tuple(r) for r in rows] == [(1, "a"), (1, "b")]


def test_expansion_stays_in_its_stream(spark, written):
    records = written([("s", "a", 1), ("s", "a", 1), ("t", "", 2)], "stream string, payload string, n int")
    assert sorted(tuple(r) for r in splitting.expand(records, twice).collect()) == [("s", "a", 1), ("s", "a", 1), ("s", "a!", 1), ("s", "a!", 1)]
    with pytest.raises(Exception, match="was moved to"):
        splitting.expand(records, moved).collect()
