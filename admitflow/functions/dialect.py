"""The few spellings in which Spark SQL and DuckDB differ, so that a rule is stated once for engine and oracle."""

from __future__ import annotations

from collections.abc import Iterable


class Dialect:
    """Builds SQL expressions; `spark` says for which engine."""

    def __init__(self, spark: bool):
        self.spark = spark

    def text(self, value: str) -> str:
        return "'" + (value.replace("\\", "\\\\").replace("'", "\\'") if self.spark else value.replace("'", "''")) + "'"

    def list(self, values: Iterable[str]) -> str:
        items = ", ".join(self.text(v) for v in values)
        return f"array({items})" if self.spark else f"[{items}]"

    def size(self, x: str) -> str:
        return f"size({x})" if self.spark else f"len({x})"

    def find_all(self, x: str, pattern: str) -> str:
        return f"regexp_extract_all({x}, {self.text(pattern)}" + (", 0)" if self.spark else ")")

    def matches(self, x: str, pattern: str) -> str:
        return f"({x} rlike {self.text(pattern)})" if self.spark else f"regexp_matches({x}, {self.text(pattern)})"

    def replace(self, x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, {self.text(pattern)}, {self.text(by)}" + (")" if self.spark else ", 'g')")

    def at(self, x: str, part: str) -> str:
        return f"instr({x}, {part})"

    def contains(self, x: str, part: str) -> str:
        return f"contains({x}, {part})"

    def let(self, name: str, value: str, body: str) -> str:
        """body with a name for value, which is evaluated once."""
        return f"transform(array({value}), {name} -> {body})[0]" if self.spark else f"list_transform([{value}], lambda {name}: {body})[1]"

    def filter(self, x: str, var: str, condition: str) -> str:
        return f"filter({x}, {var} -> {condition})" if self.spark else f"list_filter({x}, lambda {var}: {condition})"

    def map(self, x: str, var: str, value: str) -> str:
        return f"transform({x}, {var} -> {value})" if self.spark else f"list_transform({x}, lambda {var}: {value})"

    def any(self, x: str, var: str, condition: str) -> str:
        return f"exists({x}, {var} -> {condition})" if self.spark else f"(len(list_filter({x}, lambda {var}: {condition})) > 0)"

    def has(self, x: str, value: str) -> str:
        return f"array_contains({x}, {value})" if self.spark else f"list_contains({x}, {value})"

    def common(self, a: str, b: str) -> str:
        return f"array_intersect({a}, {b})" if self.spark else f"list_intersect({a}, {b})"

    def distinct(self, x: str) -> str:
        return f"array_distinct({x})" if self.spark else f"list_distinct({x})"

    def join(self, x: str, by: str) -> str:
        return f"array_join({x}, {self.text(by)})" if self.spark else f"array_to_string({x}, {self.text(by)})"

    def concat(self, *lists: str) -> str:
        return f"concat({', '.join(lists)})" if self.spark else "list_concat(" + ", ".join(lists) + ")"

    def positions(self, x: str) -> str:
        """1 to the length of x; empty for an empty list."""
        return f"slice(sequence(0, size({x})), 2, size({x}))" if self.spark else f"range(1, len({x}) + 1)"

    def around(self, spots: str, n: int) -> str:
        """The distinct numbers within n of one of the spots."""
        if self.spark:
            return f"array_distinct(flatten(transform({spots}, s -> sequence(s - {n}, s + {n}))))"
        return f"list_distinct(flatten(list_transform({spots}, lambda s: range(s - {n}, s + {n + 1}))))"

    def record(self, **fields: str) -> str:
        """A struct of named values."""
        if self.spark:
            return "named_struct(" + ", ".join(f"'{name}', {value}" for name, value in fields.items()) + ")"
        return "{" + ", ".join(f"'{name}': {value}" for name, value in fields.items()) + "}"

    def part(self, x: str, start: str, count: int) -> str:
        return f"slice({x}, {start}, {count})" if self.spark else f"list_slice({x}, {start}, {start} + {count - 1})"

    def item(self, x: str, index: str) -> str:
        return f"element_at({x}, {index})" if self.spark else f"{x}[{index}]"

    def unnest(self, x: str) -> str:
        return f"explode({x})" if self.spark else f"unnest({x})"


SPARK, DUCK = Dialect(True), Dialect(False)
