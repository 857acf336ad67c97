"""Conditions and values in Python's syntax over a row, as columns."""

from __future__ import annotations

import ast
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Functions that expressions may call.
ALLOWED = ("len", "str", "int", "float", "bool", "abs", "min", "max", "sum", "any", "all", "list", "dict", "set", "tuple", "sorted", "reversed", "enumerate", "range", "zip", "map", "filter", "round")
TEXT_METHODS = ("lower", "upper", "strip", "lstrip", "rstrip", "title", "replace", "join")
# How many arguments each takes here, least and most; more than these, or names for them, are refused.
ARGUMENTS = {
    "len": (1, 1), "str": (1, 1), "int": (1, 1), "float": (1, 1), "bool": (1, 1), "abs": (1, 1), "min": (1, 99), "max": (1, 99), "sum": (1, 1), "any": (1, 1), "all": (1, 1), "list": (1, 1), "set": (1, 1), "tuple": (1, 1),
    "sorted": (1, 1), "reversed": (1, 1), "enumerate": (1, 1), "range": (1, 3), "zip": (1, 99), "map": (2, 2), "filter": (2, 2), "round": (1, 2),
    ".lower": (0, 0), ".upper": (0, 0), ".strip": (0, 1), ".lstrip": (0, 1), ".rstrip": (0, 1), ".title": (0, 0), ".replace": (2, 2), ".join": (1, 1), ".startswith": (1, 1), ".endswith": (1, 1), ".find": (1, 1), ".split": (0, 2), ".count": (1, 1),
}
# What Python takes for white space.
BLANK = r"(?U)[\s\x1c-\x1f]"


def either(*parts: Column | None) -> Column | None:
    """True where one of the parts is; None stands for a part that is never true."""
    known = [F.coalesce(p, F.lit(False)) for p in parts if p is not None]
    return reduce(Column.__or__, known) if known else None


class Expression:
    """A condition or value in Python's syntax over `item`, as a column over a schema.

    item['a'], item.a and item.get('a') are columns; a missing value is None. A row fails where Python
    would raise (a cast, an order or arithmetic with None, a division by 0), with `and`, `or` and
    chains evaluated from left to right. Comprehensions are higher-order functions over arrays;
    failures inside their elements give null elements. What can't be a column raises ValueError when
    the plan is made.
    """

    def __init__(self, schema: T.StructType, names: Sequence[str] = ("item", "data", "input")) -> None:
        self.fields, self.names = {f.name: f.dataType for f in schema.fields}, names
        self.bound: dict[str, tuple[Column, str]] = {}
        self.whole: set[str] = set()  # loop variables that are integers

    def column(self, text: str) -> Column:
        """The value; null where the row fails."""
        node = self.parse(text)
        value, fails = self.visit(node), self.fails(node)
        return value if fails is None else F.when(~fails, value)

    def condition(self, text: str) -> Column:
        """True where the expression is true or truthy; false where it fails; never null."""
        node = self.parse(text)
        value, fails = self.truth(node), self.fails(node)
        return value if fails is None else F.when(fails, False).otherwise(value)

    def parse(self, text: str) -> ast.AST:
        if not text.strip():
            raise ValueError("an empty expression")
        return ast.parse(text.strip(), mode="eval").body

    # Which field a node reads, and of what kind a node is

    def field_name(self, node: ast.AST) -> str | None:
        match node:
            case ast.Subscript(value=ast.Name(id=name), slice=ast.Constant(value=str(key))) if name in self.names:
                return key
            case ast.Attribute(value=ast.Name(id=name), attr=key) if name in self.names:
                return key
            case ast.Call(func=ast.Attribute(value=ast.Name(id=name), attr="get"), args=[ast.Constant(value=str(key)), *_]) if name in self.names:
                return key
        return None

    def field(self, name: str) -> Column:
        if name.startswith("_"):
            raise ValueError(f"{name}: names that start with _ are not allowed")
        return F.col(f"`{name}`") if name in self.fields else F.lit(None)

    @staticmethod
    def name_of(kind: T.DataType) -> str:
        return kind.typeName() if kind.typeName() in ("string", "boolean", "array", "map", "struct") else "number"

    def kind(self, node: ast.AST) -> str:
        """string, boolean, array, map, struct, none or number."""
        if (name := self.field_name(node)) is not None:
            return self.name_of(self.fields[name]) if name in self.fields else "none"
        match node:
            case ast.Name(id=name) if name in self.bound:
                return self.bound[name][1]
            case ast.Constant(value=value):
                return "none" if value is None else "boolean" if isinstance(value, bool) else "string" if isinstance(value, str) else "number"
            case ast.JoinedStr():
                return "string"
            case ast.BoolOp(values=values):
                kinds = {self.kind(v) for v in values} - {"none"}
                return kinds.pop() if len(kinds) == 1 else "none" if not kinds else "mixed"
            case ast.Compare() | ast.UnaryOp(op=ast.Not()):
                return "boolean"
            case ast.ListComp() | ast.GeneratorExp() | ast.SetComp() | ast.List() | ast.Tuple() | ast.Set():
                return "array"
            case ast.IfExp(body=body):
                return self.kind(body)
            case ast.BinOp(left=left, op=ast.Add() | ast.Mult(), right=right):
                return "string" if "string" in (self.kind(left), self.kind(right)) else "number"
            case ast.Subscript(value=value, slice=ast.Constant()):
                return self.element(value)
            case ast.Call(func=ast.Attribute(attr=name)):
                return "boolean" if name in ("startswith", "endswith") else "string" if name in TEXT_METHODS else "array" if name == "split" else "number"
            case ast.Call(func=ast.Name(id="min" | "max"), args=[one, *rest]):
                return self.kind(one) if rest else self.element(one)
            case ast.Call(func=ast.Name(id=name)):
                return "boolean" if name in ("bool", "any", "all") else "string" if name == "str" else "array" if name in ("list", "set", "tuple", "sorted", "reversed", "enumerate", "range", "zip", "map", "filter") else "number"
        return "number"

    def element(self, node: ast.AST) -> str:
        """The kind of an array's elements."""
        name = self.field_name(node)
        if name in self.fields and isinstance(self.fields[name], T.ArrayType):
            return self.name_of(self.fields[name].elementType)
        match node:
            case ast.Call(func=ast.Attribute(attr="split")):
                return "string"
            case ast.Call(func=ast.Name(id="enumerate" | "zip")):
                return "struct"
            case ast.Call(func=ast.Name(id="sorted" | "reversed" | "list" | "set" | "tuple"), args=[of, *_]):
                return self.element(of)
            case ast.List(elts=[first, *_]) | ast.Tuple(elts=[first, *_]) | ast.Set(elts=[first, *_]):
                return self.kind(first)
            case ast.ListComp() | ast.GeneratorExp() | ast.SetComp():
                found: list[str] = []
                self.over(node, lambda: found.append(self.kind(node.elt)) or F.lit(True))
                return found[0]
        return "number"

    # Where a row fails

    def fails(self, node: ast.AST) -> Column | None:
        """True where evaluating the node raises; None if it never does."""
        if (name := self.field_name(node)) is not None:
            if isinstance(node, ast.Call):
                return self.fails(node.args[1]) if len(node.args) > 1 else None
            return None if name in self.fields else F.lit(True)
        match node:
            case ast.BoolOp(values=values, op=op):
                out = self.fails(values[-1])
                for v in reversed(values[:-1]):
                    goes_on = self.truth(v) if isinstance(op, ast.And) else ~self.truth(v)
                    out = either(self.fails(v), None if out is None else goes_on & out)
                return out
            case ast.UnaryOp(operand=of):
                return self.fails(of) if isinstance(node.op, ast.Not) else either(self.fails(of), self.visit(of).isNull())
            case ast.BinOp(left=left, right=right, op=op):
                a, b = self.visit(left), self.visit(right)
                zero = b == 0 if isinstance(op, ast.Div | ast.FloorDiv | ast.Mod) else None
                mixed = F.lit(True) if isinstance(op, ast.Add) and len({self.kind(left), self.kind(right)}) > 1 else None
                return either(self.fails(left), self.fails(right), a.isNull(), b.isNull(), zero, mixed)
            case ast.IfExp(test=test, body=body, orelse=orelse):
                yes, no = self.fails(body), self.fails(orelse)
                if yes is None and no is None:
                    return self.fails(test)
                never = F.lit(False)
                return either(self.fails(test), F.when(self.truth(test), never if yes is None else yes).otherwise(never if no is None else no))
            case ast.Compare(left=left, ops=ops, comparators=rights):
                out, lefts = None, [left, *rights[:-1]]
                for op, a, b in reversed(list(zip(ops, lefts, rights, strict=True))):
                    out = either(self.fails(b), self.order_fails(op, a, b), None if out is None else F.coalesce(self.compare(op, a, b), F.lit(False)) & out)
                return either(self.fails(left), out)
            case ast.Subscript(value=of):
                at = ast.literal_eval(node.slice)
                return either(self.fails(of), self.visit(of).isNull(), F.size(self.visit(of)) < (at + 1 if at >= 0 else -at))
            case ast.JoinedStr(values=values):
                return either(*[self.fails(v.value) for v in values if isinstance(v, ast.FormattedValue)])
            case ast.Call():
                return self.call_fails(node)
        return None

    def order_fails(self, op: ast.cmpop, left: ast.AST, right: ast.AST) -> Column | None:
        a, b = self.kind(left), self.kind(right)
        if isinstance(op, ast.In | ast.NotIn):
            if b == "string":
                return F.lit(True) if a not in ("string", "none") else self.visit(left).isNull() | self.visit(right).isNull()
            return None if isinstance(right, ast.List | ast.Tuple | ast.Set) else self.visit(right).isNull()
        if isinstance(op, ast.Lt | ast.LtE | ast.Gt | ast.GtE):
            if "none" in (a, b) or (a == "string") != (b == "string"):
                return F.lit(True)
            return self.visit(left).isNull() | self.visit(right).isNull()
        return None

    def call_fails(self, node: ast.Call) -> Column | None:
        inner = [self.fails(a) for a in node.args if not isinstance(a, ast.Lambda)]
        if isinstance(node.func, ast.Attribute):
            of = node.func.value
            return either(self.fails(of), self.visit(of).isNull(), *inner, *[self.visit(a).isNull() for a in node.args])
        name = getattr(node.func, "id", "")
        if name in ("str", "bool") or not node.args:
            return either(*inner)
        if name in ("int", "float"):
            return either(*inner, self.visit(node).isNull())
        if name in ("map", "filter"):
            return either(*inner, self.visit(node.args[1]).isNull())
        nulls = [self.visit(a).isNull() for a in node.args]
        if name in ("min", "max") and len(node.args) == 1:
            nulls.append(F.size(self.visit(node.args[0])) == 0)
        if name in ("min", "max", "sum", "sorted") and len(node.args) == 1:
            nulls.append(F.exists(self.visit(node.args[0]), lambda x: x.isNull()))
        return either(*inner, *nulls)

    # Values

    def truth(self, node: ast.AST) -> Column:
        """Whether the value is true or truthy; never null."""
        if isinstance(node, ast.BoolOp):
            return reduce(Column.__and__ if isinstance(node.op, ast.And) else Column.__or__, [self.truth(v) for v in node.values])
        value, kind = self.visit(node), self.kind(node)
        if kind == "none":
            return F.lit(False)
        true = {"string": lambda: F.length(value) > 0, "boolean": lambda: value, "array": lambda: F.size(value) > 0, "map": lambda: F.size(value) > 0, "struct": lambda: value.isNotNull()}
        return F.coalesce(true[kind]() if kind in true else value != 0, F.lit(False))

    def visit(self, node: ast.AST) -> Column:
        if (name := self.field_name(node)) is not None:
            value = self.field(name)
            return F.coalesce(value, self.visit(node.args[1])) if isinstance(node, ast.Call) and len(node.args) > 1 else value
        match node:
            case ast.Constant():
                return F.lit(node.value)
            case ast.Name(id=name) if name in self.bound:
                return self.bound[name][0]
            case ast.Subscript(slice=ast.Constant(value=int()) | ast.UnaryOp(op=ast.USub(), operand=ast.Constant(value=int()))):
                at = ast.literal_eval(node.slice)
                return F.try_element_at(self.visit(node.value), F.lit(at + 1 if at >= 0 else at))
            case ast.BoolOp(values=values, op=op):
                if self.kind(node) == "mixed":
                    raise ValueError(f"{ast.unparse(node)}: values of different kinds can't be one column")
                out = self.visit(values[-1])
                for v in reversed(values[:-1]):
                    out = F.when(self.truth(v), out).otherwise(self.visit(v)) if isinstance(op, ast.And) else F.when(self.truth(v), self.visit(v)).otherwise(out)
                return out
            case ast.UnaryOp(op=ast.Not(), operand=of):
                return ~self.truth(of)
            case ast.UnaryOp(op=ast.USub()):
                return -self.visit(node.operand)
            case ast.BinOp():
                return self.arithmetic(node)
            case ast.IfExp():
                return F.when(self.truth(node.test), self.visit(node.body)).otherwise(self.visit(node.orelse))
            case ast.Compare():
                lefts = [node.left, *node.comparators[:-1]]
                return reduce(Column.__and__, [self.compare(*x) for x in zip(node.ops, lefts, node.comparators, strict=True)])
            case ast.Call():
                return self.call(node)
            case ast.JoinedStr():
                if any(isinstance(v, ast.FormattedValue) and (v.format_spec or v.conversion != -1) for v in node.values):
                    raise ValueError(f"{ast.unparse(node)}: formats are not supported")
                return F.concat(F.lit(""), *[self.as_text(v.value) if isinstance(v, ast.FormattedValue) else self.visit(v) for v in node.values])
            case ast.List() | ast.Tuple():
                return F.array(*map(self.visit, node.elts))
            case ast.Set():
                return F.array_distinct(F.array(*map(self.visit, node.elts)))
            case ast.ListComp() | ast.GeneratorExp() | ast.SetComp():
                made = self.over(node, lambda: self.visit(node.elt))
                return F.array_distinct(made) if isinstance(node, ast.SetComp) else made
        raise ValueError(f"{ast.unparse(node)}: not supported")

    def over(self, node: ast.ListComp | ast.GeneratorExp | ast.SetComp, value: Callable[[], Column]) -> Column:
        """value for each element that a comprehension's one loop passes."""
        if len(node.generators) > 1:
            raise ValueError(f"{ast.unparse(node)}: one loop at most")
        loop = node.generators[0]
        rows, kind = self.visit(loop.iter), self.element(loop.iter)
        if loop.ifs:
            rows = F.filter(rows, lambda x: self.with_bound(loop.target, x, kind, lambda: reduce(Column.__and__, [self.truth(c) for c in loop.ifs])))
        return F.transform(rows, lambda x: self.with_bound(loop.target, x, kind, value))

    def with_bound(self, target: ast.AST, x: Column, kind: str, value: Callable[[], Column]) -> Column:
        before = dict(self.bound)
        if isinstance(target, ast.Tuple):
            self.bound |= {t.id: (x[f"_{i}"], "number") for i, t in enumerate(target.elts)}
        else:
            self.bound[target.id] = (x, kind)
        try:
            return value()
        finally:
            self.bound = before

    def as_text(self, node: ast.AST) -> Column:
        """str() of a value."""
        kind, value = self.kind(node), self.visit(node)
        if kind not in ("string", "boolean", "number", "none"):
            raise ValueError(f"{ast.unparse(node)}: only simple values can be text")
        return F.coalesce(F.when(value, "True").otherwise(F.when(~value, "False")) if kind == "boolean" else value.cast("string"), F.lit("None"))

    def integral(self, node: ast.AST, element: bool = False) -> bool:
        """Whether a number, or an array's elements, are known to be integers."""
        if (name := self.field_name(node)) in self.fields:
            kind = self.fields[name]
            return isinstance(kind.elementType if element and isinstance(kind, T.ArrayType) else kind, T.IntegralType)
        match node:
            case ast.Constant(value=value):
                return isinstance(value, int) and not isinstance(value, bool)
            case ast.List(elts=elts) | ast.Tuple(elts=elts) | ast.Set(elts=elts):
                return element and all(map(self.integral, elts))
            case ast.BinOp(op=ast.Add() | ast.Sub() | ast.Mult() | ast.Mod(), left=left, right=right):
                return self.integral(left) and self.integral(right)
            case ast.Call(func=ast.Name(id="len" | "int" | "range")):
                return True
            case ast.Call(func=ast.Name(id="sorted" | "reversed" | "list" | "set" | "tuple"), args=[of]):
                return self.integral(of, element)
            case ast.Name(id=name):
                return name in self.whole
            case ast.ListComp(elt=elt, generators=[loop]) | ast.GeneratorExp(elt=elt, generators=[loop]) | ast.SetComp(elt=elt, generators=[loop]):
                before = self.whole
                if isinstance(loop.target, ast.Name):
                    self.whole = before | {loop.target.id} if self.integral(loop.iter, True) else before - {loop.target.id}
                try:
                    return self.integral(elt)
                finally:
                    self.whole = before
        return False

    def arithmetic(self, node: ast.BinOp) -> Column:
        kinds = self.kind(node.left), self.kind(node.right)
        a, b = self.visit(node.left), self.visit(node.right)
        if isinstance(node.op, ast.Mult) and set(kinds) == {"string", "number"}:
            text, n = (a, b) if kinds[0] == "string" else (b, a)
            return F.when(n.isNotNull(), F.repeat(text, F.greatest(n, F.lit(0)).cast("int")))
        if not isinstance(node.op, ast.Add) and {"string", "array", "map", "struct"} & set(kinds):
            raise ValueError(f"{ast.unparse(node)}: not supported")
        match node.op:
            case ast.Add():
                return F.concat(a, b) if {self.kind(node.left), self.kind(node.right)} & {"string", "array"} else F.try_add(a, b)
            case ast.Sub():
                return F.try_subtract(a, b)
            case ast.Mult():
                return F.try_multiply(a, b)
            case ast.Div():
                return F.try_divide(a.cast("double"), b)
            case ast.FloorDiv():
                return F.floor(F.try_divide(a.cast("double"), b))
            case ast.Mod():
                return F.when(b != 0, (a % b + b) % b)
        raise ValueError(f"{ast.unparse(node)}: not supported")

    def compare(self, op: ast.cmpop, left: ast.AST, right: ast.AST) -> Column:
        if isinstance(op, ast.In | ast.NotIn):
            if isinstance(right, ast.List | ast.Tuple | ast.Set):
                found = reduce(Column.__or__, [self.compare(ast.Eq(), left, x) for x in right.elts], F.lit(False))
            elif self.kind(right) == "array":
                found = F.coalesce(F.array_contains(self.visit(right), self.visit(left)), F.lit(False))
            elif self.kind(left) in ("string", "none"):
                found = F.coalesce(F.contains(self.visit(right), self.visit(left)), F.lit(False))
            else:
                found = F.lit(False)
            return ~found if isinstance(op, ast.NotIn) else found
        a, b = self.visit(left), self.visit(right)
        kinds = {self.kind(left), self.kind(right)}
        if isinstance(op, ast.Eq | ast.NotEq | ast.Is | ast.IsNot):
            if "none" in kinds:
                same = a.isNull() & b.isNull()
            elif len(kinds) > 1 and "string" in kinds:
                same = a.isNull() & b.isNull()
            else:
                same = a.eqNullSafe(b)
            return ~same if isinstance(op, ast.NotEq | ast.IsNot) else same
        if "none" in kinds or len(kinds) > 1 and "string" in kinds:
            return F.lit(None).cast("boolean")  # an order between text and number fails in every row
        return {ast.Lt: a < b, ast.LtE: a <= b, ast.Gt: a > b, ast.GtE: a >= b}[type(op)]

    def method(self, node: ast.Call) -> Column:
        name, of = node.func.attr, node.func.value
        self.checked(f".{name}", node)
        if name == "join":
            if not (isinstance(of, ast.Constant) and isinstance(of.value, str)):
                raise ValueError(f"{ast.unparse(node)}: only a text can join")
            return F.array_join(self.visit(node.args[0]), of.value)
        if name == "split" and node.args:
            return self.split(node)
        args, me = [self.visit(a) for a in node.args], self.visit(of)
        literal = lambda x: F.concat(F.lit("\\Q"), x, F.lit("\\E"))
        made = {
            "lower": lambda: F.lower(me), "upper": lambda: F.upper(me), "title": lambda: self.titled(me),
            "strip": lambda: F.btrim(me, *args) if args else F.regexp_replace(me, f"{BLANK}+$|^{BLANK}+", ""), "lstrip": lambda: F.ltrim(me, *args) if args else F.regexp_replace(me, f"^{BLANK}+", ""), "rstrip": lambda: F.rtrim(me, *args) if args else F.regexp_replace(me, f"{BLANK}+$", ""),
            "startswith": lambda: F.startswith(me, *args), "endswith": lambda: F.endswith(me, *args), "replace": lambda: F.replace(me, *args), "find": lambda: F.instr(me, *args) - 1,
            "split": lambda: F.filter(F.split(me, f"{BLANK}+"), lambda x: x != ""), "count": lambda: F.regexp_count(me, literal(args[0])),
        }
        if name not in made:
            raise ValueError(f".{name}() is not supported")
        return made[name]()

    def checked(self, name: str, node: ast.Call) -> None:
        """Refuses arguments that aren't handled."""
        least, most = ARGUMENTS.get(name, (0, 99))
        if not least <= len(node.args) <= most or any(isinstance(a, ast.Starred) for a in node.args):
            raise ValueError(f"{ast.unparse(node)}: {name}() takes {least} to {most} arguments here")
        for k in node.keywords:
            if not (name == "sorted" and k.arg == "reverse" and isinstance(k.value, ast.Constant) and isinstance(k.value.value, bool)):
                raise ValueError(f"{ast.unparse(node)}: {k.arg}= is not supported")

    def split(self, node: ast.Call) -> Column:
        """split by a text, at most so many times."""
        by, most = node.args[0], node.args[1] if len(node.args) > 1 else ast.Constant(value=-1)
        try:
            n = ast.literal_eval(most)
        except ValueError:
            n = None
        if not (isinstance(by, ast.Constant) and isinstance(by.value, str) and by.value) or type(n) is not int:
            raise ValueError(f"{ast.unparse(node)}: a text that isn't empty and a number are needed")
        return F.split(self.visit(node.func.value), "\\Q" + by.value.replace("\\E", "\\E\\\\E\\Q") + "\\E", n + 1 if n >= 0 else -1)

    @staticmethod
    def titled(text: Column) -> Column:
        """Letters after what isn't a letter are upper case, all others lower case."""
        letters = F.split(text, "")
        letter = lambda c: F.rlike(c, F.lit(r"^\p{L}$"))
        return F.array_join(F.transform(letters, lambda c, i: F.when((i == 0) | ~letter(F.get(letters, i - 1)), F.upper(c)).otherwise(F.lower(c))), "")

    def applied(self, node: ast.Call) -> Column:
        """map or filter with a lambda of one argument."""
        f, of = node.args
        if not isinstance(f, ast.Lambda) or len(f.args.args) != 1:
            raise ValueError(f"{ast.unparse(node)}: a lambda of one argument is needed")
        target, kind = ast.Name(id=f.args.args[0].arg), self.element(of)
        if node.func.id == "map":
            return F.transform(self.visit(of), lambda x: self.with_bound(target, x, kind, lambda: self.visit(f.body)))
        return F.filter(self.visit(of), lambda x: self.with_bound(target, x, kind, lambda: self.truth(f.body)))

    def call(self, node: ast.Call) -> Column:
        if isinstance(node.func, ast.Attribute):
            return self.method(node)
        name = getattr(node.func, "id", "")
        if name not in ALLOWED:
            raise ValueError(f"{name}() is not allowed")
        if name == "round":
            digits = [k.value for k in node.keywords if k.arg == "ndigits"]
            node = ast.Call(func=node.func, args=[*node.args, *digits], keywords=[k for k in node.keywords if k.arg != "ndigits"])
        self.checked(name, node)
        if name in ("map", "filter"):
            return self.applied(node)
        if name in ("any", "all"):
            of = node.args[0]
            holds = self.over(of, lambda: self.truth(of.elt)) if isinstance(of, ast.GeneratorExp | ast.ListComp) else F.transform(self.visit(of), lambda x: self.with_bound(ast.Name(id="x"), x, self.element(of), lambda: self.truth(ast.Name(id="x"))))
            return (F.exists if name == "any" else F.forall)(holds, lambda x: x)
        args = [self.visit(a) for a in node.args]
        one = node.args[0] if node.args else None
        span = [F.lit(0), *args] if len(args) == 1 else args
        by = ast.literal_eval(node.args[2]) if name == "range" and len(args) > 2 else 1
        if type(by) is not int or not by:
            raise ValueError(f"{ast.unparse(node)}: the step is a number other than 0")
        down = any(k.arg == "reverse" and getattr(k.value, "value", False) for k in node.keywords)
        made = {
            "len": lambda: F.size(args[0]) if self.kind(one) in ("array", "map") else F.length(args[0]), "str": lambda: self.as_text(one), "bool": lambda: self.truth(one),
            "int": lambda: args[0].try_cast("long") if self.kind(one) == "string" else args[0].try_cast("double").try_cast("long"), "float": lambda: args[0].try_cast("double"), "abs": lambda: F.abs(args[0]),
            "min": lambda: F.least(*args) if len(args) > 1 else F.array_min(args[0]), "max": lambda: F.greatest(*args) if len(args) > 1 else F.array_max(args[0]),
            "round": lambda: F.bround(args[0], ast.literal_eval(node.args[1]) if len(args) > 1 else 0), "sum": lambda: F.aggregate(args[0], F.lit(0).cast("long"), lambda a, b: a + b.cast("long")) if self.integral(one, True) else F.aggregate(args[0], F.lit(0.0), lambda a, b: a + b),
            "sorted": lambda: F.sort_array(args[0], not down), "reversed": lambda: F.reverse(args[0]), "list": lambda: args[0], "tuple": lambda: args[0], "set": lambda: F.array_distinct(args[0]),
            "enumerate": lambda: F.transform(args[0], lambda x, i: F.struct(i.alias("_0"), x.alias("_1"))), "zip": lambda: self.zipped(args),
            "range": lambda: F.filter(F.sequence(span[0], (F.greatest if by > 0 else F.least)(span[1], span[0]), F.lit(by)), lambda x: x < span[1] if by > 0 else x > span[1]),
        }
        if name not in made:
            raise ValueError(f"{name}() can't be a column")
        return made[name]()

    @staticmethod
    def zipped(args: list[Column]) -> Column:
        """Structs of the arrays' elements at each place, as many as the shortest has."""
        least = F.least(*[F.size(a) for a in args]) if len(args) > 1 else F.size(args[0])
        at = F.filter(F.sequence(F.lit(1), F.greatest(least, F.lit(1))), lambda i: i <= least)
        return F.transform(at, lambda i: F.struct(*[F.element_at(a, i).alias(f"_{k}") for k, a in enumerate(args)]))
