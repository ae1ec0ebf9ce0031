"""The schema's constraints checked in one scan per table.

``row_violations`` compiles a table's NOT NULL, domain and length rules into one array of
violations per row and inlines it. ``key_violations`` compiles all keys and references: each
row gives one entry per key and per reference of its table, an entry being (the key's domain,
its value); one aggregate over the entries of all tables finds keys held twice and references
without a key, so the references to a key need neither a join nor a scan of their own, and a
value held by a third of the rows costs one row per map task. ``violations`` is both at once:
row violations travel as entries of the same aggregate.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parkops.sources import schema as S

TableFn = Callable[[str], DataFrame]
Pair = tuple[str, tuple[str, ...]]


@dataclass(frozen=True)
class Rules:
    """Which constraints are checked. ``SCHEMA`` has all that the schema declares."""

    keys: Sequence[Pair] = ()
    references: Sequence[tuple[str, str, str, str]] = ()
    domains: Sequence[tuple[str, str, Sequence[str]]] = ()
    not_null: Sequence[tuple[str, str]] = ()
    max_lengths: Sequence[tuple[str, str, int]] = ()

    def tables(self) -> list[str]:
        named = [r[0] for rs in (self.keys, self.references, self.domains, self.not_null,
                                 self.max_lengths) for r in rs] + [r[2] for r in self.references]
        return list(dict.fromkeys(named))

    def key_domains(self) -> dict[str, Pair]:
        """Name of each key's domain -> (table, columns), of keys and referenced columns."""
        keys = list(self.keys) + [(parent, (pcol,)) for _, _, parent, pcol in self.references]
        return {f"{t}.{','.join(k)}": (t, tuple(k)) for t, k in keys}

    def slots(self) -> dict[str, list[tuple[str, str]]]:
        """Domain of a key -> the references to it; a reference is known by its place."""
        out: dict[str, list[tuple[str, str]]] = {}
        for child, col, parent, pcol in self.references:
            out.setdefault(f"{parent}.{pcol}", []).append((child, col))
        return out


ALL_KEYS = (*S.PRIMARY_KEYS.items(), *((t, k) for t, ks in S.UNIQUE_KEYS.items() for k in ks))
SCHEMA = Rules(ALL_KEYS, S.FOREIGN_KEYS, S.DOMAINS, S.NOT_NULL, S.MAX_LENGTHS)


def key_text(cols: Sequence[str]) -> Column:
    return F.concat_ws("|", *[F.col(c).cast("string") for c in cols])


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _row_rules(table: str, columns: Sequence[str], rules: Rules) -> list[Column]:
    """Per rule of the table a struct (rule, column_name, value, value_len, max_len), null where
    the row keeps it. Rules on columns the table doesn't have are left out."""
    def entry(broken: Column, rule: str, col: str, length: Column, most: int | None) -> Column:
        return F.when(broken, F.struct(
            F.lit(rule).alias("rule"), F.lit(col).alias("column_name"),
            F.col(col).cast("string").alias("value"), length.cast("int").alias("value_len"),
            F.lit(most).cast("int").alias("max_len")))

    none, mine = F.lit(None), lambda r: r[0] == table and r[1] in columns
    return ([entry(F.col(c).isNull(), "not_null", c, none, None) for _, c in filter(mine, rules.not_null)]
            + [entry(F.col(c).isNotNull() & ~F.col(c).isin(*allowed), "domain", c, none, None)
               for _, c, allowed in filter(mine, rules.domains)]
            + [entry(F.octet_length(c) > n, "max_length", c, F.octet_length(c), n)
               for _, c, n in filter(mine, rules.max_lengths)])


def row_violations(table: TableFn, rules: Rules = SCHEMA) -> DataFrame:
    """(rule, table_name, column_name, key, value, value_len, max_len): one row per broken rule
    of a row, from one scan of each table that has rules."""
    parts = []
    for t in rules.tables():
        df = table(t)
        found = _row_rules(t, df.columns, rules)
        if found:
            parts.append(df.select(key_text(S.PRIMARY_KEYS[t]).alias("key"),
                                   F.inline(F.filter(F.array(*found), lambda v: v.isNotNull())))
                         .select("rule", F.lit(t).alias("table_name"), "column_name", "key", "value",
                                 "value_len", "max_len"))
    return _union(parts)


KEY, ROW = -1, -2  # slots of a key's own entries and of row violations


def _entries(t: str, df: DataFrame, rules: Rules) -> list[Column]:
    """A table's entries (domain, value, none, slot, note), null where a row has none."""
    def entry(domain: Column, value: Column, none: Column, slot: int, note: Column) -> Column:
        return F.struct(domain.alias("domain"), value.alias("value"), none.alias("none"),
                        F.lit(slot).alias("slot"), note.alias("note"))

    blank, no = F.lit(None).cast("string"), F.lit(False)
    out = [entry(F.lit(d), key_text(cols),
                 reduce(lambda a, b: a & b, [F.col(c).isNull() for c in cols]), KEY, blank)
           for d, (table, cols) in rules.key_domains().items() if table == t]
    for d, refs in rules.slots().items():
        out += [F.when(F.col(col).isNotNull(), entry(F.lit(d), F.col(col).cast("string"), no, i, blank))
                for i, (child, col) in enumerate(refs) if child == t and col in df.columns]
    for rule in _row_rules(t, df.columns, rules):
        out.append(F.when(rule.isNotNull(), entry(
            F.concat(F.lit(f"{t}:"), rule["rule"], F.lit(":"), rule["column_name"]),
            key_text(S.PRIMARY_KEYS[t]), no, ROW, rule["value"])))
    return out


def _grouped(table: TableFn, rules: Rules) -> DataFrame:
    """(domain, value, n_key, n_row, note, n0, n1, ..): the entries of all tables, counted."""
    parts = []
    for t in rules.tables():
        df = table(t)
        entries = _entries(t, df, rules)
        if entries:
            parts.append(df.select(F.inline(F.filter(F.array(*entries), lambda e: e.isNotNull()))))
    count = lambda slot: F.sum(F.when(F.col("slot") == slot, 1).otherwise(0)).cast("long")
    width = max(map(len, rules.slots().values()), default=0)
    return (_union(parts).groupBy("domain", "value", "none")
            .agg(count(KEY).alias("n_key"), count(ROW).alias("n_row"), F.min("note").alias("note"),
                 *[count(i).alias(f"n{i}") for i in range(width)]))


def _readout(grouped: DataFrame, rules: Rules) -> DataFrame:
    """(rule, table_name, column_name, parent_table, key, value, n) of the broken rules."""
    def broken(when: Column, rule: Column, t: Column, col: Column, parent: Column, key: Column,
               value: Column, n: Column) -> Column:
        return F.when(when, F.struct(
            rule.alias("rule"), t.alias("table_name"), col.alias("column_name"),
            parent.alias("parent_table"), key.alias("key"), value.alias("value"), n.alias("n")))

    blank = F.lit(None).cast("string")
    dotted = lambda i: F.split("domain", "[.]", 2)[i]
    of = lambda i: F.split("domain", ":", 3)[i]
    found = [broken(F.col("n_row") > 0, of(1), of(0), of(2), blank, F.col("value"), F.col("note"),
                    F.col("n_row"))]
    unique = [f"{t}.{','.join(k)}" for t, k in rules.keys]
    if unique:
        found.append(broken(F.col("domain").isin(*unique) & (F.col("n_key") > 1), F.lit("unique"),
                            dotted(0), dotted(1), blank, blank, F.col("value"), F.col("n_key")))
    for d, refs in rules.slots().items():
        found += [broken((F.col("domain") == d) & (F.col("n_key") == 0) & (F.col(f"n{i}") > 0),
                         F.lit("foreign_key"), F.lit(child), F.lit(col), F.lit(d.split(".")[0]),
                         blank, F.col("value"), F.col(f"n{i}"))
                  for i, (child, col) in enumerate(refs)]
    return grouped.select(F.inline(F.filter(F.array(*found), lambda v: v.isNotNull())))


def violations(table: TableFn, rules: Rules = SCHEMA) -> DataFrame:
    """(rule, table_name, column_name, parent_table, key, value, n): every broken rule of every
    table, from one scan per table and one shuffle. Rows that break a rule and share their
    table's key are one violation with their number and the least of their values."""
    return _readout(_grouped(table, rules), rules)
