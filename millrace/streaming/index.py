"""An inverted index beside a current view, kept up to date from the same change log."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.columns import search_tokens
from millrace.operators.search import Request, frequencies, phrases_of, scored
from millrace.operators.view import KEY
from millrace.storage import COMPRESSED, Scratch, tidy, written
from millrace.streaming.pipeline import ViewTable, rounds
from millrace.streaming.postings import BITS, cells, lengths, places, without

TASKS = 8  # a bucket of terms is written by as many tasks, as one term can have a posting of every row
CELLS = "term string, _block long, places binary"
POSTINGS = "term string, _seg int, _block long, places binary, _bucket int"
POSTED = ("term", "_seg", "_block", "places", "_bucket")
PLACES = "term string, _seg int, _row long, positions array<int>, _bucket int"
PACKED = COMPRESSED | {"parquet.compression.codec.zstd.level": "3", "parquet.enable.dictionary#places": "false"}  # 2 % larger than at level 6
GONE = "_seg int, _row long, len int"


class SearchIndex(ViewTable):
    """A view whose text is indexed: postings with positions, in buckets by the hash of the term.

    A batch adds a segment: its rows (_row is their number in it, _seg the segment's), with the
    columns that searches show, and the postings of their terms, which name _seg and _row only, packed as one
    binary for each term and block of 2048 rows (a bucket more has how many tokens each row has). Rows that went are listed as dead; their postings stay until `compact`, which makes one segment of
    all that live. A search reads the buckets of its terms, the rows and the dead, but no other
    postings and no texts; the number of rows and of their tokens stands in the commit. View and
    segments have one commit, so they can't disagree. `stored` are columns that searches may filter
    by, beside the key.
    """

    tops = ("data", "postings", "rows", "dead")

    def __init__(self, spark: SparkSession, path: str, key: Sequence[str] = KEY, text: str = "text", stored: Sequence[str] = (), terms: int = 64, **options: Any) -> None:
        super().__init__(spark, path, key, **options)
        self.text, self.terms = text, terms
        self.columns = [*self.key, self.seq, *[c for c in stored if c not in self.key]]

    def folders(self, content: dict[str, Any]) -> set[str]:
        segments = content.get("segments", [])
        return super().folders(content) | {f"{top}/{s}" for top in ("postings", "rows") for s in segments} | {f"dead/{d}" for d in content.get("dead", [])}

    def _term_bucket(self, term: Column, n: int) -> Column:
        return (F.crc32(term.cast("binary")) % n).cast("int")

    def _write(self, postings: DataFrame, segment: str) -> None:
        """Adds to a segment: a folder for each bucket, rows by term. They are sorted by the term alone, as most terms differ in the bytes that Spark compares first; the write then sorts by bucket and keeps that order. spark_partition_id is there so that Spark doesn't drop the first sort for the second."""
        ordered = postings.sortWithinPartitions("term").withColumn("_bucket", F.when(F.spark_partition_id() >= 0, F.col("_bucket")))
        ordered.write.mode("append").options(**PACKED).partitionBy("_bucket").parquet(f"{self.path}/postings/{segment}")

    def _written(self, rows: DataFrame, at: str) -> DataFrame:
        rows.write.options(**COMPRESSED).parquet(f"{self.path}/{at}")
        return self.spark.read.schema(rows.schema).parquet(f"{self.path}/{at}")

    def _live(self, content: dict[str, Any]) -> DataFrame | None:
        """_seg, _row, len and columns of the rows that are indexed and not dead; None before the first."""
        if not content.get("segments"):
            return None
        if "packed" not in content:
            raise ValueError("the index was made by an earlier version; build it anew")
        rows = self.spark.read.schema(T.StructType.fromJson(content["rows"])).parquet(*[f"{self.path}/rows/{s}" for s in content["segments"]])
        return self._without(content, rows)

    def _gone(self, content: dict[str, Any]) -> DataFrame:
        return self.spark.read.schema(GONE).parquet(*[f"{self.path}/dead/{d}" for d in content["dead"]])

    def _without(self, content: dict[str, Any], rows: DataFrame) -> DataFrame:
        return rows.join(self._gone(content).select("_seg", "_row"), ["_seg", "_row"], "left_anti") if content["dead"] else rows

    def prepare(self, content: dict[str, Any], fresh: Sequence[DataFrame], log: DataFrame) -> dict[str, Any]:
        terms, number, segment, dead = content.get("terms", self.terms), content.get("made", 0) + 1, f"segment={uuid.uuid4().hex}", uuid.uuid4().hex
        made = {"packed": True, "terms": terms, "made": number, "segments": content.get("segments", []), "dead": content.get("dead", []), "n": content.get("n", 0), "tokens": content.get("tokens", 0)}
        if (live := self._live(content)) is not None:
            gone = self._written(live.join(log.select(*self.key).distinct(), self._same(live, log), "left_semi").select("_seg", "_row", "len"), f"dead/{dead}")
            lost = gone.agg(F.count("*").alias("n"), F.sum("len").alias("tokens")).first()
            made |= {"n": made["n"] - lost["n"], "tokens": made["tokens"] - (lost["tokens"] or 0), "dead": [*made["dead"], dead] if lost["n"] else made["dead"]}
        text = F.coalesce(F.col(self.text), F.lit(""))
        plain = F.octet_length(text) == F.length(text)  # of ASCII only: nothing to fold
        folded = F.when(plain, text).otherwise(F.array_join(search_tokens(text), " "))
        bucket = F.when(F.col("term") == "", terms).otherwise(self._term_bucket(F.col("term"), terms))
        for part in fresh:
            dealt = part.select("_row", folded.alias("_text")).mapInArrow(cells, CELLS).withColumn("_bucket", bucket).repartition("_bucket", F.pmod("_block", F.lit(max(1, TASKS // len(fresh)))))
            self._write(dealt.withColumn("_seg", F.lit(number)).select(*POSTED), segment)
        every = fresh[0]
        for part in fresh[1:]:
            every = every.unionByName(part)
        lens = self._blocks([segment]).where(F.col("_bucket") == terms).select("_block", "places").mapInArrow(lengths, "_row long, len int")
        joined = every.select("_row", *self.columns).join(lens, "_row", "left")
        rows = self._written(joined.select(F.lit(number).alias("_seg"), "_row", F.coalesce("len", F.lit(0)).alias("len"), *self.columns), f"rows/{segment}")
        came = rows.agg(F.count("*").alias("n"), F.sum("len").alias("tokens")).first()
        made["rows"] = rows.schema.jsonValue()
        if not came["n"]:
            return made
        return made | {"segments": [*made["segments"], segment], "n": made["n"] + came["n"], "tokens": made["tokens"] + came["tokens"]}

    def _blocks(self, segments: Sequence[str]) -> DataFrame:
        at = [f"{self.path}/postings/{s}" for s in segments if any(name.startswith("_bucket=") for name in self.folder.names(f"postings/{s}"))]
        return self.spark.read.schema(POSTINGS).option("basePath", f"{self.path}/postings").parquet(*at).select(*POSTED) if at else self.spark.createDataFrame([], POSTINGS)

    def _postings(self, content: dict[str, Any], terms: Sequence[str] | None = None) -> DataFrame:
        rows = self._blocks(content["segments"])
        if terms is None:
            rows = rows.where(F.col("_bucket") < content["terms"])
        else:
            numbers = {zlib.crc32(t.encode()) % content["terms"] for t in terms}
            rows = rows.where(F.col("_bucket").isin(*sorted(numbers)) & F.col("term").isin(*terms))
        return rows.mapInArrow(places, PLACES)

    def postings(self, content: dict[str, Any], terms: Sequence[str] | None = None) -> DataFrame:
        """All postings of some terms, with sign: 1, or -1 if their row is dead; other buckets aren't read."""
        rows = self._postings(content, terms)
        if not content["dead"]:
            return rows.withColumn("sign", F.lit(1))
        gone = self._gone(content).select("_seg", "_row", F.lit(-1).alias("_sign"))
        return rows.join(gone, ["_seg", "_row"], "left").withColumn("sign", F.coalesce("_sign", F.lit(1))).drop("_sign")

    def _hits(self, content: dict[str, Any], request: Request) -> DataFrame:
        if (live := self._live(content)) is None:
            return self._listed(content, request).limit(0)
        phrases = phrases_of(self.spark, request.terms())
        terms = sorted({t for p in phrases for t in p.split(" ")})
        place = {t: F.col(f"_p{i}") for i, t in enumerate(terms)}
        at = self._postings(content, terms).groupBy("_seg", "_row").agg(*[F.max(F.when(F.col("term") == t, F.col("positions"))).alias(f"_p{i}") for i, t in enumerate(terms)])
        rows = at.join(live, ["_seg", "_row"]).withColumnRenamed("len", "_len")

        def occurrences(phrase: str) -> Column:
            first, *rest = phrase.split(" ")
            at = place[first]
            for k, term in enumerate(rest, 1):
                at = F.array_intersect(at, F.transform(place[term], lambda x: x - k))  # noqa: B023
            return F.coalesce(F.size(at), F.lit(0))

        counted = rows.select(*self.columns, "_len", *[F.greatest(occurrences(p), F.lit(0)).alias(f"_tf{i}") for i, p in enumerate(phrases)])
        average = content["tokens"] / content["n"] if content["tokens"] else 1.0  # of no tokens no row is a hit
        stats = counted.agg(F.lit(content["n"]).alias("_n"), F.lit(average).alias("_avg"), *frequencies(len(phrases)))
        return scored(counted, stats, len(phrases), request.where).select(*self.columns, "score")

    def _listed(self, content: dict[str, Any], request: Request) -> DataFrame:
        rows = self._rows(content, None).select(*self.columns).withColumn("score", F.lit(0.0))
        for column, value in request.where:
            rows = rows.where(F.col(column) == value)
        return rows

    def _content(self, request: Request) -> dict[str, Any]:
        content = self.commits.newest()[1]
        if not content:
            raise ValueError("nothing has been indexed yet")
        if unknown := {c for c, _ in request.where} - set(self.columns):
            raise ValueError(f"not stored in the index: {sorted(unknown)}")
        return content

    def search(self, request: Request) -> DataFrame:
        """A page of hits (key, seq, stored columns, score), best first, ties by seq; without terms all rows, the latest first, with score 0. The same pages as a search over the view's rows."""
        content = self._content(request)
        rows = self._hits(content, request).orderBy(F.desc("score"), self.seq) if request.terms() else self._listed(content, request).orderBy(F.desc(self.seq))
        return rows.offset(request.offset).limit(request.limit)

    def total(self, request: Request) -> DataFrame:
        """The number of hits on all pages."""
        content = self._content(request)
        return (self._hits(content, request) if request.terms() else self._listed(content, request)).agg(F.count("*").alias("total"))

    def rows(self, page: DataFrame) -> DataFrame:
        """The view's rows of a page, with score; only their buckets are read."""
        with Scratch() as scratch:
            page = scratch.keep(written(page, "page"))
        found = self.lookup(page)
        score = page.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(self.key)], "score")
        same = F.lit(True)
        for i, c in enumerate(self.key):
            same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
        return found.join(F.broadcast(score), same).drop(*[f"_k{i}" for i in range(len(self.key))])

    def _lost(self, content: dict[str, Any]) -> DataFrame:
        """Of each block with dead rows: _left, how many of its rows aren't, and _dead, a bit for each row that is, in longs."""
        block, last = F.shiftright("_row", BITS).alias("_block"), F.col("_row").bitwiseAND((1 << BITS) - 1)
        gone = self._gone(content).select("_seg", block, F.shiftright(last, 6).alias("_long"), F.expr("shiftleft(1L, cast(_row & 63 as int))").alias("_bit"))
        longs = [F.coalesce(F.bit_or(F.when(F.col("_long") == i, F.col("_bit"))), F.lit(0).cast("long")) for i in range(1 << BITS - 6)]
        dead = gone.groupBy("_seg", "_block").agg(F.array(*longs).alias("_dead"))
        live = self._live(content).groupBy("_seg", block).agg(F.count("*").alias("_left"))
        return dead.join(live, ["_seg", "_block"], "left").withColumn("_left", F.coalesce("_left", F.lit(0)))

    def compact(self) -> int:
        """Makes one segment of those there are, without dead rows. Segments that others add meanwhile stay beside it, and what they list as dead stays dead. Returns how many were merged."""
        _, content = self.commits.newest()
        merged, dead = content.get("segments", []), content.get("dead", [])
        if len(merged) < 2:
            return 0
        segment = f"segment={uuid.uuid4().hex}"
        with Scratch(), tidy(self.spark):
            self._written(self._live(content), f"rows/{segment}")
            groups = rounds(range(content["terms"]), sum(self.folder.size(f"postings/{s}") for s in merged))
            lost = written(self._lost(content), "lost") if dead else None
            for group in groups:
                rows = self._blocks(merged).where(F.col("_bucket").isin(*group))
                if lost is not None:
                    cut = rows.join(lost.where("_left > 0"), ["_seg", "_block"]).select(*POSTED, "_dead").mapInArrow(without, POSTINGS)
                    rows = rows.join(lost, ["_seg", "_block"], "left_anti").select(*POSTED).unionByName(cut)
                self._write(rows.repartition("_bucket", F.pmod("_block", F.lit(TASKS))), segment)
        while True:
            version, content = self.commits.newest()
            left = {"segments": [segment, *[s for s in content["segments"] if s not in merged]], "dead": [d for d in content["dead"] if d not in dead]}
            if self.commits.add(version + 1, content | left):
                self.prune()
                return len(merged)
