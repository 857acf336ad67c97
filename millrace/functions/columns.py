"""Column expressions: identities, hashes, text measures, vectors, JSON and money."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "\x1f"  # fixed: between the parts of an identity
VOLATILE = ("observed_at", "provenance")  # fixed: not part of a version


def record_id(source: Column, stream: Column, native_id: Column) -> Column:
    """SHA-256 of source, stream and native id; null if a part is null."""
    return F.sha2(F.concat(source, F.lit(SEPARATOR), stream, F.lit(SEPARATOR), native_id.cast("string")), 256)


def canonical_json(**fields: Column) -> Column:
    """A JSON object with keys in order and null fields kept."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def version_hash(**fields: Column) -> Column:
    """SHA-256 of the canonical JSON of an envelope's fields without those that change from run to run."""
    return F.sha2(canonical_json(**{k: v for k, v in fields.items() if k not in VOLATILE}), 256)


def typed_key(**parts: Column) -> Column:
    """A native id of several typed parts: [{"name","type","value"}, ...] in the order given."""
    one = lambda k, v: F.struct(F.lit(k).alias("name"), F.typeof(v).alias("type"), v.cast("string").alias("value"))
    return F.to_json(F.array(*[one(k, v) for k, v in parts.items()]))


def _accents() -> tuple[str, str]:
    pairs = [(chr(c), d[0]) for c in range(0xC0, 0x1F00 + 0x100) if len(d := unicodedata.normalize("NFD", chr(c))) > 1 and unicodedata.combining(d[1])]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def folded(text: Column) -> Column:
    """Lower case without accents."""
    return F.lower(F.translate(text, *_accents()))


def search_tokens(text: Column) -> Column:
    """Runs of letters and digits of the folded text."""
    return F.filter(F.split(folded(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def words(text: Column) -> Column:
    """Pieces between white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda t: t != "")


def sentences(text: Column) -> Column:
    """Pieces after . ! or ? and white space, trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(F.trim(F.coalesce(text, F.lit(""))), r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")


def text_quality(text: Column) -> Column:
    """0.65 for the number of visible characters (200 suffice), 0.35 for the share of letters and digits, less the share of replacement characters; from 0 to 1."""
    visible = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s", "")
    n = F.length(visible)
    wrong = n - F.length(F.regexp_replace(visible, "[�\\x00]", ""))
    alnum = F.length(F.regexp_replace(visible, r"[^\p{L}\p{N}]", ""))
    score = F.least(n / 200.0, F.lit(1.0)) * 0.65 + alnum / n * 0.35 - wrong / n
    return F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def page_count(text: Column, chars: int = 3000) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / chars)).cast("int")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if a vector is null, empty or zero, or the lengths differ."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norms > 0), dot(a, b) / norms).otherwise(0.0)


def template(text: str, values: dict[str, Column]) -> Column:
    """{{ name }} replaced by values; ValueError for a name that isn't there. A null value shows as None."""
    import re

    parts: list[Column] = []
    for i, piece in enumerate(re.split(r"\{\{\s*([A-Za-z_][A-Za-z0-9_.]*)\s*\}\}", text)):
        if i % 2 and piece not in values:
            raise ValueError(f"template: {piece} is undefined")
        parts.append(F.coalesce(values[piece].cast("string"), F.lit("None")) if i % 2 else F.lit(piece))
    return F.concat(*parts)


def fenced_json(response: Column) -> Column:
    """The JSON text of a model's response: all of it if it parses, else what a fenced block holds, else null."""
    fence = F.regexp_extract(response, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    ok = lambda c: F.when(F.try_parse_json(c).isNotNull(), c)
    return F.coalesce(ok(F.trim(response)), ok(fence))


def confidence(value: Column) -> Column:
    """A number between 0 and 1; 0 if it isn't a number."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(value.try_cast("double"), F.lit(0.0))))


def model_cost(tokens: Column, per_million: Column) -> Column:
    """Tokens at a price per million, to ten places; an unknown price costs nothing."""
    return F.round(tokens / 1e6 * F.coalesce(per_million, F.lit(0.0)), 10)


def next_interval(anchor: Column, now: Column, seconds: int) -> Column:
    """The first time after now, in whole steps from anchor; what was missed is skipped."""
    passed = F.unix_timestamp(now) - F.unix_timestamp(anchor)
    steps = F.when(passed < 0, 0).otherwise(F.floor(passed / seconds) + 1)
    return F.timestamp_seconds(F.unix_timestamp(anchor) + steps * seconds)


def column_names(values: Sequence[object]) -> list[str]:
    """Header cells as names: blanks become column_N, repeats get _2, _3 ..."""
    seen: dict[str, int] = {}
    out = []
    for n, value in enumerate(values, 1):
        name = ("" if value is None else str(value).strip()) or f"column_{n}"
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return out
