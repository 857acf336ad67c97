import math
import random

import pytest

from millrace.functions.expressions import Expression

SCHEMA = "a bigint, b bigint, x double, s string, t string, f boolean, n array<bigint>, w array<string>, z array<double>"
VALUES = [
    "item['a'] % item['b']", "item['a'] + item['b'] * 2", "item['s'].strip()", "item['s'].lstrip()", "item['s'].rstrip()", "item['s'].strip('ab ')", "item['s'].lstrip('a')", "item['s'].rstrip('b')", "item['s'].title()",
    "item['s'].split()", "item['s'].split(' ')", "item['s'].split('a', 1)", "item['s'].split('.', 2)", "item['s'].replace('a', 'bb')", "item['s'].find('b')", "item['s'].upper()", "item['s'] * 3", "2 * item['s']", "item['s'] * item['a']",
    "str(item['f'])", "str(item['a'])", "f\"{item['f']}-{item['s']}-{item['a']}\"", "item['s'] or 'd'", "item['s'] and item['t']", "item['a'] or item['b'] or 7", "item['a'] and item['b']", "not item['s']",
    "range(item['a'], item['b'])", "range(5, 0, -1)", "range(item['a'], item['b'], -2)", "range(0, 9, 4)", "range(3)", "sum(item['n'])", "sum([v * 2 for v in item['n']])", "sum(item['z'])", "sorted(item['n'])", "sorted(item['n'], reverse=True)",
    "min(item['a'], item['b'])", "max(item['a'], 3)", "len(item['s'])", "','.join(item['w'])", "[v.upper() for v in item['w'] if v]", "any(v > 2 for v in item['n'])", "all(v > 2 for v in item['n'])", "'yes' if item['a'] > item['b'] else 'no'",
    "round(item['x'], 1)", "round(item['x'], ndigits=2)", "abs(item['a'])", "item['a'] in [1, 2, -3]", "'a' in item['s']", "item['s'].count('a')", "item['s'].startswith('a')",
]
REFUSED = [
    "sorted(item['n'], key=len)", "min(item['w'], key=len)", "max(item['n'], default=0)", "item['s'].find('a', 2)", "item['s'].replace('a', 'b', 1)", "item['s'].join(item['w'])", "item['s'].split('')", "item['s'] % 3", "item['s'] - 1",
    "sum(item['n'], 3)", "range(1, 5, 0)", "f\"{item['a']:03d}\"", "f\"{item['s']!r}\"", "item['a'] and item['s']", "str(item['n'])", "round(item['x'], 1, 2)", "int('1', 2)", "item['s'].strip('a', 'b')", "enumerate(item['n'], 1)", "open('x')",
]


def rows(n):
    r = random.Random(7)
    text = lambda: "".join(r.choice("ab .\n\t'éA1\x1c") for _ in range(r.randrange(9)))
    return [(r.randrange(-7, 8), r.choice([-3, -2, 1, 2, 5]), r.choice([0.25, 2.675, -1.5, 7 / 3]), text(), text(), r.random() < 0.5, [r.randrange(9) for _ in range(r.randrange(4))], [text() for _ in range(r.randrange(4))], [r.random() for _ in range(r.randrange(4))]) for _ in range(n)]


def plain(v):
    if isinstance(v, range | list | tuple):
        return [plain(x) for x in v]
    return round(v, 9) if isinstance(v, float) else v


def test_values_are_those_of_python(spark):
    data, names = rows(120), [c.split()[0] for c in SCHEMA.split(", ")]
    table = spark.createDataFrame(data, SCHEMA)
    e = Expression(table.schema)
    got = table.select(*[e.column(v).alias(str(i)) for i, v in enumerate(VALUES)]).collect()
    for row, out in zip(data, got, strict=True):
        item = dict(zip(names, row, strict=True))
        for i, v in enumerate(VALUES):
            want = plain(eval(v, {"item": item}))
            have = plain(out[str(i)])
            if isinstance(want, float) and "round" in v:
                assert math.isclose(want, have, abs_tol=0.11), (v, item, want, have)
            else:
                assert have == want and isinstance(have, bool) is isinstance(want, bool), (v, item, want, have)


@pytest.mark.parametrize("text", REFUSED)
def test_what_is_not_handled_is_refused(spark, text):
    with pytest.raises(ValueError):
        Expression(spark.createDataFrame([], SCHEMA).schema).column(text)
