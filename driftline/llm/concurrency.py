"""Peak concurrency: how many spells are open, and what they are worth, at every moment of every key.

A spell is open from its start (included) to its end (excluded; null: for ever). Time is cut in chunks of
2 ** bits units. A chunk of a key is swept by one task: its spells sorted by start, a min-heap of ends from
which finished ones are popped on the way. Spells open at the left border seed the chunk: those that end in
it stand in the heap from the beginning, those that outlast it only count. So a spell reaches two chunks at
most, however long it is. What the borders carry (open spells and their worth, the highest so far, the next
moment) are running sums over chunks, inside spans of 2 ** span_bits chunks and then over spans.

Equal (key, start, end) are summed before they are dealt, so a chunk holds as many rows as it has
moments and pairs of them, not as many as there are spells. No window is longer than a span: what goes
through a task is bounded by units of time, not by rows. Nothing is broadcast or brought to the driver.

Odd input: spells of a null start or an end not after the start take no part, nor does a null key; null
worth counts 0; repeated rows count each; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Seconds of a chunk, 4.6 hours, and chunks of a span, 2.1 years, as powers of two.
BITS, SPAN_BITS = 14, 12
#: Rows that the sweep hands on at once.
ROWS = 1 << 15
DAY = 86_400
ALL_NATIONS, NO_NATION = -2, -1

_SWEPT = "key int, chunk long, from_s long, to_s long, n long, worth long, high long"


def utc_seconds(df: DataFrame, name: str) -> Column:
    """Seconds since 1970 of a time, rounded down; a time without a zone is taken as UTC, whatever the session's zone."""
    c = F.col(f"`{name}`")
    if df.schema[name].dataType.typeName() != "timestamp_ntz":
        return F.unix_seconds(c.cast("timestamp"))
    days = F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return days * DAY + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, chunk, start, end, n, worth) sorted by the first three -> moments that change n or worth, counted from the chunk's left border."""
    schema = pa.schema([("key", pa.int32()), *((c, pa.int64()) for c in "chunk from_s to_s n worth high".split())])
    out: list[tuple] = []
    group = None
    ends: dict[int, list[int]] = {}
    heap: list[int] = []
    at = held = None  # the moment being summed up; the last one told, which waits for the next one's time
    dn = dw = n = worth = high = 0

    def told(to: int | None) -> None:
        if held is not None:
            out.append((*group, held[0], to, *held[1:]))

    def passed() -> None:
        """The moment `at` is over."""
        nonlocal held, dn, dw, n, worth, high
        if dn or dw:
            n, worth = n + dn, worth + dw
            high = n if held is None else max(high, n)
            told(at)
            held = (at, n, worth, high)
        dn = dw = 0

    def moved(t: int, more: int, more_worth: int) -> None:
        nonlocal at, dn, dw
        if t != at:
            passed()
            at = t
        dn, dw = dn + more, dw + more_worth

    def popped(until: int | None) -> None:
        while heap and (until is None or heap[0] <= until):
            t = heapq.heappop(heap)
            gone = ends.pop(t)
            moved(t, -gone[0], -gone[1])

    def closed() -> None:
        nonlocal at, held, n, worth, high
        popped(None)
        passed()
        told(None)
        at = held = None
        n = worth = high = 0

    for batch in batches:
        for key, chunk, start, end, count, w in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (key, chunk) != group:
                if group is not None:
                    closed()
                group = (key, chunk)
            if start is not None:
                popped(start)
                moved(start, count, w)
            if end is not None:
                if end in ends:
                    ends[end][0] += count
                    ends[end][1] += w
                else:
                    ends[end] = [count, w]
                    heapq.heappush(heap, end)
        if len(out) >= ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out.clear()
    if group is not None:
        closed()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def _before(chunks: DataFrame, sums: tuple[str, ...] = (), highs: tuple[str, ...] = (), nexts: tuple[str, ...] = ()) -> DataFrame:
    """chunks with before_x (sum, or highest, of x over the key's earlier chunks) and next_x (x of its next chunk)."""
    earlier = (Window.unboundedPreceding, -1)
    inside = Window.partitionBy("key", "span").orderBy("chunk")
    over = Window.partitionBy("key").orderBy("span")
    spans = chunks.groupBy("key", "span").agg(
        *[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in highs], *[F.min(c).alias(c) for c in nexts]
    )
    carried = spans.select(
        "key",
        "span",
        *[F.sum(c).over(over.rowsBetween(*earlier)).alias(f"_{c}") for c in sums],
        *[F.max(c).over(over.rowsBetween(*earlier)).alias(f"_{c}") for c in highs],
        *[F.lead(c).over(over).alias(f"_{c}") for c in nexts],
    )
    own = chunks.select(
        "*",
        *[F.sum(c).over(inside.rowsBetween(*earlier)).alias(f"before_{c}") for c in sums],
        *[F.max(c).over(inside.rowsBetween(*earlier)).alias(f"before_{c}") for c in highs],
        *[F.lead(c).over(inside).alias(f"next_{c}") for c in nexts],
    )
    zero = F.lit(0)
    return (
        own.join(carried.hint("merge"), ["key", "span"])
        .withColumns({f"before_{c}": F.coalesce(f"before_{c}", zero) + F.coalesce(f"_{c}", zero) for c in sums})
        .withColumns({f"before_{c}": F.greatest(f"before_{c}", f"_{c}") for c in highs})
        .withColumns({f"next_{c}": F.coalesce(f"next_{c}", f"_{c}") for c in nexts})
        .drop(*[f"_{c}" for c in (*sums, *highs, *nexts)])
    )


def concurrency(spells: DataFrame, tag: str = "", bits: int = BITS, span_bits: int = SPAN_BITS) -> DataFrame:
    """spells (key int, start, end, worth: long) -> key, from_s, to_s, n_open, open_worth, high_open, is_peak.

    A row for each moment of a key whose starts and ends together change the number open or their worth.
    """
    kept = spells.filter(F.col("key").isNotNull() & F.col("start").isNotNull() & (F.col("end").isNull() | (F.col("end") > F.col("start"))))
    chunk = F.shiftright("start", bits)
    last = F.shiftright("end", bits)
    stays = last.isNull() | (last > chunk)
    never = F.lit(None).cast("long")
    piece = lambda c, s, e: F.struct(c.alias("chunk"), s.alias("start"), e.alias("end"))
    begun = piece(chunk, F.col("start"), F.when(~stays, F.col("end")).otherwise(never))
    seed = piece(last, never, F.col("end"))
    moves = (
        kept.select("key", F.coalesce("worth", F.lit(0)).alias("worth"), F.explode(F.when(stays & last.isNotNull(), F.array(begun, seed)).otherwise(F.array(begun))).alias("p"))
        .groupBy("key", "p.chunk", "p.start", "p.end")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("worth").alias("worth"))
        .repartition("key", "chunk")
        .sortWithinPartitions("key", "chunk", "start")  # seeds first
        .select("key", "chunk", "start", "end", "n", "worth")
    )
    swept = materialize(moves.mapInArrow(_sweep, _SWEPT), "swept", tag)
    chunks = swept.groupBy("key", "chunk").agg(
        F.min("from_s").alias("first"),
        F.max_by(F.struct("n", "worth"), "from_s").alias("at_end"),
        F.max("high").alias("high"),
        F.max("worth").alias("worth"),
    )
    chunks = chunks.select("key", F.shiftright("chunk", span_bits).alias("span"), "chunk", "first", F.col("at_end.n").alias("n"), F.col("at_end.worth").alias("w"), "high", "worth")
    chunks = _before(chunks, sums=("n", "w"), nexts=("first",))
    chunks = chunks.withColumns({"high": F.col("high") + F.col("before_n"), "worth": F.col("worth") + F.col("before_w")})
    chunks = materialize(_before(chunks, highs=("high",)), "borders", tag)
    peaks = chunks.groupBy("key").agg(F.max("worth").alias("peak"))
    borders = chunks.join(peaks.hint("merge"), "key").select("key", "chunk", "before_n", "before_w", "before_high", "next_first", "peak")
    n, worth = F.col("n") + F.col("before_n"), F.col("worth") + F.col("before_w")
    return swept.join(borders.hint("merge"), ["key", "chunk"]).select(
        "key",
        "from_s",
        F.coalesce("to_s", "next_first").alias("to_s"),
        n.alias("n_open"),
        worth.alias("open_worth"),
        F.greatest(F.col("high") + F.col("before_n"), F.col("before_high")).alias("high_open"),
        (worth == F.col("peak")).alias("is_peak"),
    )


def open_sales(sales: DataFrame, lines: DataFrame, clients: DataFrame, tag: str = "") -> DataFrame:
    """The spells of sales: from sold_at to a day after the first shipped_at of their lines, for the client's nation and for ALL_NATIONS.

    Worth is the total in cents, 0 if null or not finite. Of several rows of one client the least nation counts.
    Both right sides are written first: joins of plain tables let adaptive execution split a client or sale of many rows.
    """
    shipped = (
        lines.select(F.col("sale_id").alias("_sale"), utc_seconds(lines, "shipped_at").alias("_shipped"))
        .filter(F.col("_sale").isNotNull() & F.col("_shipped").isNotNull())
        .groupBy("_sale")
        .agg((F.min("_shipped") + DAY).alias("end"))
    )
    nations = clients.filter(F.col("client_id").isNotNull()).groupBy(F.col("client_id").alias("_client")).agg(F.min("nation_id").alias("_nation"))
    cents = F.floor(100 * F.col("total") + 0.5)
    finite = F.abs(F.col("total")) < float("inf")
    rows = sales.select("sale_id", "client_id", utc_seconds(sales, "sold_at").alias("start"), F.when(finite & ~F.isnan("total"), cents).otherwise(0).cast("long").alias("worth"))
    return (
        rows.filter(F.col("start").isNotNull())
        .join(materialize(shipped, "shipped", tag).hint("merge"), F.col("sale_id") == F.col("_sale"), "left")
        .join(materialize(nations, "nations", tag).hint("merge"), F.col("client_id") == F.col("_client"), "left")
        .select(F.explode(F.array(F.coalesce(F.col("_nation").cast("int"), F.lit(NO_NATION)), F.lit(ALL_NATIONS))).alias("key"), "start", "end", "worth")
    )


def sales_concurrency(sales: DataFrame, lines: DataFrame, clients: DataFrame, tag: str = "") -> DataFrame:
    """nation_id, from_s, to_s, n_open, open_cents, high_open, is_peak of the sales open at each moment."""
    return concurrency(open_sales(sales, lines, clients, tag), tag=tag).withColumnsRenamed({"key": "nation_id", "open_worth": "open_cents"})


SQL = """
    WITH shipped AS (
        SELECT sale_id, CAST(floor(epoch_us(min(shipped_at)) / 1000000.0) AS BIGINT) + 86400 AS t
        FROM sale_lines WHERE shipped_at IS NOT NULL GROUP BY sale_id
    ), nations AS (SELECT client_id, min(nation_id) AS nation_id FROM clients GROUP BY client_id),
    spells AS (
        SELECT coalesce(c.nation_id, -1) AS nation_id, CAST(floor(epoch_us(s.sold_at) / 1000000.0) AS BIGINT) AS a, e.t AS b,
               CAST(coalesce(floor(100 * s.total + 0.5), 0) AS BIGINT) AS cents
        FROM sales s LEFT JOIN shipped e USING (sale_id) LEFT JOIN nations c ON c.client_id = s.client_id
        WHERE s.sold_at IS NOT NULL
    ), good AS (SELECT * FROM spells WHERE b IS NULL OR b > a),
    both_keys AS (SELECT * FROM good UNION ALL SELECT -2, a, b, cents FROM good),
    moves AS (
        SELECT nation_id, a AS t, 1 AS n, cents FROM both_keys
        UNION ALL SELECT nation_id, b, -1, -cents FROM both_keys WHERE b IS NOT NULL
    ), moments AS (
        SELECT nation_id, t, sum(n) AS n, sum(cents) AS c FROM moves GROUP BY nation_id, t HAVING sum(n) <> 0 OR sum(cents) <> 0
    ), sums AS (
        SELECT nation_id, t, lead(t) OVER w AS to_s, sum(n) OVER w AS n_open, sum(c) OVER w AS open_cents
        FROM moments WINDOW w AS (PARTITION BY nation_id ORDER BY t)
    )
    SELECT CAST(nation_id AS INTEGER) AS nation_id, t AS from_s, to_s, CAST(n_open AS BIGINT) AS n_open, CAST(open_cents AS BIGINT) AS open_cents,
           CAST(max(n_open) OVER (PARTITION BY nation_id ORDER BY t) AS BIGINT) AS high_open,
           open_cents = max(open_cents) OVER (PARTITION BY nation_id) AS is_peak
    FROM sums
"""
