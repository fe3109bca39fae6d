"""Column profiles: row, null and distinct counts, range, likely key, short value lists.

A scan turns each row into one small cell per column, (column, value in one of four types), and cells are grouped by
both. Every figure comes from that one grouping. Several ``count(distinct)`` in one aggregate would make Spark copy each
row once per column with all the columns as grouping keys; cells are one value wide, repeated values are combined before
the shuffle, and the input is computed once however it is made.

Whole numbers, and what is one underneath (dates, instants, truth values, decimals of up to 18 digits), are grouped by
word: 64 neighbouring values share a row whose bits tell which of them occur. Distinct counts are counts of bits. A
dense key or date column so travels as a bitmap, and a sparse one as a row per value like any other.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablehealth.functions import typing as kinds
from tablehealth.functions.text import percent
from tablehealth.schemas import SAMPLE_VALUES

# A column with at most this many distinct values also reports the values.
LISTED_VALUES = 10
# Neighbouring whole numbers that share a word, as a power of two: the bits of a long.
WORD_BITS = 6
# Decimals of up to so many digits are whole numbers of their smallest unit.
LONG_DIGITS = 18
# Texts longer than this are told apart by their SHA-256 digest, so that whole documents are read but do not travel
# through the shuffle. If a column with few values has such texts, a second look fetches them.
LONG_TEXT = 256
# Columns whose cells one scan makes.
COLUMNS_PER_SCAN = 32
# A rule looks at columns with an unique rate from here on (see `refine`).
NEAR_UNIQUE = 0.9
# Estimates are taken to be off by no more than this many standard deviations.
DEVIATIONS = 5

MODES = ("exact", "refined", "approx")


def profile(
    df: DataFrame,
    table: str = "table",
    *,
    columns: Sequence[str] | None = None,
    mode: str = "exact",
    rsd: float = 0.05,
    listed: int = LISTED_VALUES,
) -> DataFrame:
    """One row per column of ``df``.

    ``exact`` is lazy and exact for every column. ``approx`` estimates distinct counts in one scan
    and shuffles almost nothing. ``refined`` runs the estimates, then counts exactly those columns
    whose estimate is small or close to the row count; ``is_exact`` tells which is which. Exactly counted columns
    with at most ``listed`` distinct values also have them in ``values``, whole however long they are.
    """
    return profile_many({table: df}, columns=columns, mode=mode, rsd=rsd, listed=listed)


def profile_many(
    tables: Mapping[str, DataFrame],
    *,
    columns: Sequence[str] | None = None,
    mode: str = "exact",
    rsd: float = 0.05,
    listed: int = LISTED_VALUES,
) -> DataFrame:
    """Profiles of several tables as one job; the tables' scans run side by side.

    Options are those of :func:`profile`; ``columns`` applies to every table.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, got {mode!r}")
    parts: list[DataFrame] = []
    for table, df in tables.items():
        fields = _fields(df, table, columns)
        data = _by_position(df)
        if mode == "exact":
            parts += _exact(data, table, fields, listed)
        elif mode == "approx":
            parts += _estimated(data, table, fields, rsd, listed)
        else:
            parts += refine(data, table, fields, rsd, listed)
    return _derive(union_all(parts))


def refine(
    data: DataFrame, table: str, fields: list[tuple[int, T.StructField]], rsd: float, listed: int
) -> list[DataFrame]:
    """Estimates first; exact counts where a rule could turn on the difference.

    The estimates come to the driver as one small row per column, like a schema does.
    """
    rows = union_all(_estimated(data, table, fields, rsd, listed)).collect()
    by_ordinal = dict(fields)
    off = DEVIATIONS * rsd
    settled, open_fields = [], []
    for row in rows:
        few = row.unique_count <= listed * (1 + off) + 1
        close = few or row.unique_count >= NEAR_UNIQUE * (1 - off) * row.total_rows
        if row.is_exact or not close:
            settled.append(row)
        else:
            open_fields.append((row.ordinal, by_ordinal[row.ordinal]))
    parts = _exact(data, table, open_fields, listed)
    if settled:
        parts.append(data.sparkSession.createDataFrame(settled, _STATS))
    return parts


def union_all(parts: list[DataFrame]) -> DataFrame:
    """Union of like columns as a balanced tree, which keeps plans of many branches shallow."""
    while len(parts) > 1:
        parts = [
            parts[i].union(parts[i + 1]) if i + 1 < len(parts) else parts[i]
            for i in range(0, len(parts), 2)
        ]
    return parts[0]


def accepted_values(
    df: DataFrame, columns: Sequence[str], table: str = "table", limit: int = LISTED_VALUES
) -> DataFrame:
    """Whole lists of distinct values as sorted text, for the columns with at most ``limit``.

    Meant for columns known to hold few values: repeated values are combined before the shuffle.
    """
    rows = union_all(_exact(_by_position(df), table, _fields(df, table, columns), limit))
    return rows.where(F.col("unique_count") <= limit).select(
        "table", "ordinal", "column", "unique_count", F.col("listed").alias("values")
    )


def sample_rows(df: DataFrame, n: int = 5, order_by: Sequence[str] | None = None) -> DataFrame:
    """``n`` arbitrary rows, or the first ``n`` in a given order."""
    return (df.orderBy(*order_by) if order_by else df).limit(n)


def repeatable_rows(df: DataFrame, n: int = 5, seed: str = "") -> DataFrame:
    """``n`` rows that are the same for any partitioning, order or engine version: those of the least MD5.

    Every task keeps its ``n`` least rows and these are merged, so nothing is sorted or shuffled as a whole. Equal rows
    are drawn together, up to ``n``. Another ``seed`` draws other rows. Column names do not matter, their order does.
    """
    data = _by_position(df)
    parts = [_as_text(_column(data, i), f.dataType) for i, f in enumerate(df.schema.fields, 1)]
    # Lengths keep apart what would read the same when joined; nulls differ from empty texts.
    marked = [F.coalesce(F.concat(F.length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in parts]
    drawn = data.orderBy(F.md5(F.concat(F.lit(seed), *marked).cast("binary"))).limit(n)
    return drawn.toDF(*df.columns)


def sample_values(
    df: DataFrame,
    table: str = "table",
    n: int = 3,
    order_by: Sequence[str] | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """The first ``n`` values of every column as text.

    The few rows are taken to the driver: Spark then stops after the first partitions instead
    of starting a task for each.
    """
    fields = _fields(df, table, columns)
    data = _by_position(df.orderBy(*order_by) if order_by else df)
    rows = data.select(
        [_as_text(_column(data, i), f.dataType).alias(f"c{i}") for i, f in fields]
    ).take(n)
    return df.sparkSession.createDataFrame(
        [(table, i, f.name, [row[f"c{i}"] for row in rows]) for i, f in fields], SAMPLE_VALUES
    )


_STATS = T.StructType(
    [
        T.StructField("table", T.StringType()),
        T.StructField("ordinal", T.IntegerType()),
        T.StructField("column", T.StringType()),
        T.StructField("data_type", T.StringType()),
        T.StructField("total_rows", T.LongType()),
        T.StructField("non_null_count", T.LongType()),
        T.StructField("unique_count", T.LongType()),
        T.StructField("is_exact", T.BooleanType()),
        T.StructField("min_val", T.StringType()),
        T.StructField("max_val", T.StringType()),
        T.StructField("listed", T.ArrayType(T.StringType())),
    ]
)


def _by_position(df: DataFrame) -> DataFrame:
    """``df`` with columns that can be told apart: renamed where names differ only in case."""
    if len({name.lower() for name in df.columns}) == len(df.columns):
        return df
    return df.toDF(*[f"c{i}" for i in range(1, len(df.columns) + 1)])


def _name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _column(data: DataFrame, ordinal: int) -> Column:
    return F.col(_name(data.columns[ordinal - 1]))


def _fields(
    df: DataFrame, table: str, columns: Sequence[str] | None
) -> list[tuple[int, T.StructField]]:
    fields = list(enumerate(df.schema.fields, 1))
    if columns is not None:
        wanted = set(columns)
        missing = wanted - {f.name for _, f in fields}
        if missing:
            raise ValueError(f"{table} has no column {', '.join(sorted(missing))}")
        fields = [(i, f) for i, f in fields if f.name in wanted]
    if not fields:
        raise ValueError(f"{table} has no columns to profile")
    return fields


def _as_text(column: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.BinaryType):
        return F.hex(column)
    if kinds.holds_variant(kind):
        return F.to_json(column)
    return column.cast("string")


def _exact(
    data: DataFrame, table: str, fields: list[tuple[int, T.StructField]], listed: int
) -> list[DataFrame]:
    """Statistics of each column from its distinct values and their counts."""
    plain = [(i, f) for i, f in fields if _is_plain(f.dataType)]
    parts = [
        _of_values(_values(data, part), data, table, part, listed) for part in _scans(plain)
    ]
    for one in fields:
        if not _is_plain(one[1].dataType):
            parts.append(_of_values(_values_alone(data, one), data, table, [one], listed))
    return parts


def _scans(fields: list[tuple[int, T.StructField]]) -> list[list[tuple[int, T.StructField]]]:
    step = COLUMNS_PER_SCAN
    return [fields[at : at + step] for at in range(0, len(fields), step)]


def _is_plain(kind: T.DataType) -> bool:
    """Whether the text of a value tells it apart and can be turned back into it."""
    simple = (T.BooleanType, T.BinaryType, T.DateType, T.TimestampType, T.TimestampNTZType)
    return kinds.is_numeric(kind) or kinds.is_plain_text(kind) or isinstance(kind, simple)


def _is_whole(kind: T.DataType) -> bool:
    """Whether a value is a whole number of 64 bits underneath."""
    if isinstance(kind, T.DecimalType):
        return kind.precision <= LONG_DIGITS
    return isinstance(kind, (T.IntegralType, T.DateType, T.TimestampType, T.BooleanType))


# What every column of a table adds to a plan is SQL text: one call to Spark instead of dozens for each.
_CELL = {"whole": "long", "real": "double", "moment": "timestamp_ntz", "text": "string"}


def _cell(column: str, kind: T.DataType) -> tuple[str, str]:
    """Under which name of ``_CELL`` a value is grouped, and how: so that it is told apart and can be turned back."""
    if isinstance(kind, T.DateType):
        return "whole", f"cast(unix_date({column}) as long)"
    if isinstance(kind, T.TimestampType):
        return "whole", f"unix_micros({column})"  # a local time may stand for two instants
    if isinstance(kind, T.DecimalType) and _is_whole(kind):
        return "whole", f"cast({column} * {10**kind.scale}BD as long)"
    if _is_whole(kind):
        return "whole", f"cast({column} as long)"
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return "real", f"cast({column} as double) + 0D"  # one zero
    if isinstance(kind, T.TimestampNTZType):
        return "moment", column
    return "text", f"hex({column})" if isinstance(kind, T.BinaryType) else f"cast({column} as string)"


def _shown(fields: list[tuple[int, T.StructField]], cell: dict[str, str]) -> str:
    """A cell of the column ``at`` as the text of the value it stands for."""
    places: dict[T.DataType, list[str]] = {}
    for at, (_, f) in enumerate(fields):
        places.setdefault(f.dataType, []).append(str(at))
    cases = []
    for kind, here in places.items():
        name = _cell("", kind)[0]
        value = cell[name]
        if isinstance(kind, T.DateType):
            value = f"date_from_unix_date(cast({value} as int))"
        elif isinstance(kind, T.TimestampType):
            value = f"timestamp_micros({value})"
        elif isinstance(kind, T.BooleanType):
            value = f"{value} = 1"
        elif name == "whole" and isinstance(kind, T.DecimalType):
            unit = f"{Decimal((0, (1,), -kind.scale)):f}BD"
            value = f"cast(cast({value} as decimal(20,0)) * {unit} as {kind.simpleString()})"
        elif name == "real":
            value = f"cast({value} as {kind.simpleString()})"
        if name != "text":
            cases.append(f"when at in ({', '.join(here)}) then cast({value} as string)")
    return f"case {' '.join(cases)} else {cell['text']} end" if cases else cell["text"]


def _has_long(kind: T.DataType) -> bool:
    return isinstance(kind, (T.StringType, T.BinaryType))


def _cells(
    data: DataFrame, fields: list[tuple[int, T.StructField]], keep: Sequence[str] = ()
) -> DataFrame:
    """``at`` (place in ``fields``) and the value under one of four names, a row per row and column.

    The columns in ``keep`` go along with every cell.
    """
    items = []
    for at, (i, f) in enumerate(fields):
        name, value = _cell(_name(data.columns[i - 1]), f.dataType)
        typed = (f"'{c}', cast({value if c == name else 'null'} as {kind})" for c, kind in _CELL.items())
        items.append(f"named_struct('at', {at}, {', '.join(typed)})")
    # A join would add this condition to some uses of the cells and so keep them from sharing a scan.
    return data.selectExpr(*map(_name, keep), f"inline(array({', '.join(items)}))").where("at is not null")


def _keyed(cells: DataFrame) -> DataFrame:
    is_long = f"coalesce(length(text) > {LONG_TEXT}, false)"
    key = f"case when {is_long} then sha2(cast(text as binary), 256) else text end"
    return cells.selectExpr("*", f"{key} as k", f"{is_long} as is_long")


def _values(data: DataFrame, fields: list[tuple[int, T.StructField]]) -> DataFrame:
    """Each column's distinct values with their number ``n``: a row per word of whole numbers, with the ``bits`` that
    occur, and else a row per value, long texts as digests in ``k``."""
    bit = f"shiftleft(1L, cast(whole & {2**WORD_BITS - 1} as int))"  # the remainder, also of negative numbers
    return (
        _keyed(_cells(data, fields))
        .groupBy("at", F.expr(f"shiftright(whole, {WORD_BITS}) as word"), "real", "moment", "k", "is_long")
        .agg(F.expr(f"bit_or({bit}) as bits"), F.expr("count(1) as n"))
    )


def _values_alone(data: DataFrame, field: tuple[int, T.StructField]) -> DataFrame:
    """The same for one column that is grouped by its own type; ``v`` holds the value."""
    column, kind = _column(data, field[0]), field[1].dataType
    if kinds.holds_variant(kind):  # not groupable as such
        column = F.to_json(column)
    counted = data.groupBy(column.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return counted.selectExpr(*_nothing("0", "cast(v as string)"), "n", "v")


def _nothing(at: str, k: str) -> list[str]:
    """A row of values that holds ``k`` at most."""
    empty = {"word": "long", "real": "double", "moment": "timestamp_ntz"}
    return [
        f"{at} as at", *(f"cast(null as {kind}) as {name}" for name, kind in empty.items()),
        f"cast({k} as string) as k", "false as is_long", "cast(null as long) as bits",
    ]


_ENDS = {"low": "min", "high": "max"}
# How many different values a row of values stands for.
_SIZE = """case when word is not null then bit_count(bits)
    else cast(real is not null or moment is not null or k is not null as int) end"""


def _end(end: str) -> str:
    """The least or the largest of the whole numbers of a word."""
    digits = f"bin({end}_bits)"
    after = f"length({digits}) - " + ("1" if end == "high" else f"length(rtrim('0', {digits}))")
    return f"shiftleft({end}_word, {WORD_BITS}) | cast({after} as long)"


def _of_values(
    values: DataFrame, data: DataFrame, table: str, fields: list[tuple[int, T.StructField]], listed: int
) -> DataFrame:
    """Figures of each column. The uses of ``values`` share its shuffle, as each reads all its columns."""
    none = data.sparkSession.range(len(fields)).selectExpr(*_nothing("cast(id as int)", "null"), "0L as n")
    alone = "v" in values.columns
    if alone:
        none = none.withColumn("v", F.lit(None).cast(values.schema["v"].dataType))
    figures = [
        "sum(n) as total_rows",
        f"coalesce(sum(case when {_SIZE} > 0 then n end), 0) as non_null_count",
        # Tied to the number, as every use below has to read all of a row for the shuffle to be shared.
        f"sum(cast(case when n > 0 then {_SIZE} else 0 end as long)) as unique_count",
        *(f"{f}(word) as {end}_word" for end, f in _ENDS.items()),
        *(f"{f}_by(bits, word) as {end}_bits" for end, f in _ENDS.items()),
        *(f"{f}({name}) as {end}_{name}" for name in ("real", "moment") for end, f in _ENDS.items()),
        *_ranges(fields, alone),
    ]
    stats = values.unionByName(none).groupBy("at").agg(*map(F.expr, figures))
    few = F.broadcast(stats.where(f"unique_count between 1 and {listed}").select("at"))

    def some(condition: str) -> str:
        """The condition, tied to the counts so that it cannot move below the grouping and split its uses."""
        return f"case when {condition} then n + {_SIZE} else 0 end > 0"

    own = values.join(few, "at")
    numbers = f"filter(sequence(0, {2**WORD_BITS - 1}), i -> getbit(bits, i) = 1)"
    found = {
        "whole": f"shiftleft(word, {WORD_BITS}) | cast(i as long)", "real": "real", "moment": "moment", "text": "k",
    }
    texts = (
        own.where(some(f"not is_long and {_SIZE} > 0"))
        .selectExpr("at", "word", "real", "moment", "k",
                    f"explode(case when word is not null then {numbers} else array(0) end) as i")
        .selectExpr("at", f"{_shown(fields, found)} as text")
    )
    if any(_has_long(f.dataType) and _is_plain(f.dataType) for _, f in fields):
        # At most `listed` digests of each column.
        wanted = F.broadcast(own.where(some("is_long")).select("at", "k"))
        cells = _keyed(_cells(data, fields)).where("is_long")
        long_ones = cells.join(wanted, ["at", "k"], "left_semi").groupBy("at", "k").agg(
            F.any_value("text").alias("text")
        )
        texts = texts.unionByName(long_ones.select("at", "text"))
    lists = texts.groupBy("at").agg(F.expr("array_sort(collect_list(text)) as found"))
    low, high = (
        _if_ranged(fields, {
            "whole": _end(end), "real": f"{end}_real", "moment": f"{end}_moment", "text": f"{end}_text",
        })
        for end in _ENDS
    )
    # A list may be long, as its texts are whole: Spark broadcasts it only if it has measured it as small.
    return stats.join(lists, "at", "left").select(
        *_identities(table, fields),
        *map(F.expr, (
            "total_rows", "non_null_count", "unique_count", "true as is_exact",
            f"{low} as min_val", f"{high} as max_val",
            "coalesce(found, case when unique_count = 0 then cast(array() as array<string>) end) as listed",
        )),
    )


def _if_ranged(fields: list[tuple[int, T.StructField]], cell: dict[str, str]) -> str:
    ranged = [str(at) for at, (_, f) in enumerate(fields) if kinds.has_range(f.dataType)]
    if not ranged:
        return "cast(null as string)"
    return f"case when at in ({', '.join(ranged)}) then {_shown(fields, cell)} end"


def _ranges(fields: list[tuple[int, T.StructField]], alone: bool) -> list[str]:
    """``low_text`` and ``high_text``: the range of what is grouped as text, taken in the column's own type."""
    places: dict[str, list[str]] = {}
    for at, (_, f) in enumerate(fields):
        if kinds.has_range(f.dataType) and (alone or _cell("", f.dataType)[0] == "text"):
            places.setdefault(f.dataType.simpleString(), []).append(str(at))
    found = []
    for end, f in _ENDS.items():
        values = [
            "v" if alone else f"case when at in ({', '.join(here)}) then try_cast(k as {kind}) end"
            for kind, here in places.items()
        ]
        texts = ["cast(null as string)", *(f"cast({f}({value}) as string)" for value in values)]
        found.append(f"coalesce({', '.join(texts)}) as {end}_text")
    return found


def _identities(table: str, fields: list[tuple[int, T.StructField]]) -> list[Column]:
    def at(values: list) -> Column:
        return F.get(F.array(*map(F.lit, values)), F.col("at"))

    return [
        F.lit(table).alias("table"),
        at([i for i, _ in fields]).alias("ordinal"),
        at([f.name for _, f in fields]).alias("column"),
        at([f.dataType.simpleString() for _, f in fields]).alias("data_type"),
    ]


def _estimated(
    data: DataFrame, table: str, fields: list[tuple[int, T.StructField]], rsd: float, listed: int
) -> list[DataFrame]:
    """Distinct counts by sketch, the rest exact: a scan with a few small rows per task to shuffle."""
    plain = [(i, f) for i, f in fields if _is_plain(f.dataType)]
    parts = _exact(data, table, [x for x in fields if not _is_plain(x[1].dataType)], listed)
    present = " or ".join(f"{name} is not null" for name in _CELL)
    for part in _scans(plain):
        none = data.sparkSession.range(len(part)).selectExpr(
            "cast(id as int) as at", *(f"cast(null as {kind}) as {name}" for name, kind in _CELL.items()), "0 as n"
        )
        figures = [
            "sum(n) as total_rows",
            f"count(case when {present} then 1 end) as non_null_count",
            f"approx_count_distinct(case when {present} then struct({', '.join(_CELL)}) end, {rsd}D) as unique_count",
            *(f"{f}({name}) as {end}_{name}" for name in ("whole", "real", "moment") for end, f in _ENDS.items()),
            *_ranges(part, alone=False),
        ]
        cells = _cells(data, part).selectExpr("*", "1 as n").unionByName(none).selectExpr("*", "text as k")
        low, high = (_if_ranged(part, {name: f"{end}_{name}" for name in _CELL}) for end in _ENDS)
        parts.append(
            cells.groupBy("at").agg(*map(F.expr, figures)).select(
                *_identities(table, part),
                *map(F.expr, (
                    "total_rows", "non_null_count", "unique_count", "false as is_exact",
                    f"{low} as min_val", f"{high} as max_val", "cast(null as array<string>) as listed",
                )),
            )
        )
    return parts


def _derive(stats: DataFrame) -> DataFrame:
    total, filled, unique = F.col("total_rows"), F.col("non_null_count"), F.col("unique_count")
    return stats.select(
        "table",
        "ordinal",
        "column",
        "data_type",
        "total_rows",
        "non_null_count",
        "unique_count",
        "is_exact",
        "min_val",
        "max_val",
        percent(total - filled, total, 2, 0.0).alias("null_rate"),
        percent(unique, total, 2, 0.0).alias("unique_rate"),
        (F.col("is_exact") & (filled == total) & (unique == total) & (total > 0)).alias(
            "is_likely_pk"
        ),
        F.col("listed").alias("values"),
    )
