"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, compared by subtraction and peeling.

Only DataFrame functions. A sketch has three tables of cells; a digest enters one cell of each. A cell holds how
many digests entered it, and the XOR of the digests and of their check sums, so sketches subtract cell
by cell and what two texts share is gone. A cell left with one digest names it; taking that digest out of its
two other cells may leave further cells with one, and so on.
"""

from __future__ import annotations

import uuid

from pyspark.ml.feature import QuantileDiscretizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonemill.runtime import shared_dir, work_table

#: Cells in each of a fingerprint's three tables.
WIDTH = 8
TABLES = 3
#: Passes over the three tables before a sketch counts as failed.
ROUNDS = 4
#: A paragraph longer than this ends with the sentence that passes it.
LEAST_CHARS = 60
#: Wider sketches have this many times the cells that the differing digests could fill.
SPARE = 2.0

_PARAGRAPH = r"[^\n]{%d,}?[.!?](?=\s|$)|[^\n]+"


def paragraph_digests(text: Column, least_chars: int = LEAST_CHARS) -> Column:
    """The distinct XXH64 digests of a text's paragraphs, without blanks around them; blank ones don't count.

    A paragraph is a line; a line of several sentences is cut after each sentence that brings the paragraph
    past ``least_chars`` characters.
    """
    found = F.regexp_extract_all(text, F.lit(_PARAGRAPH % least_chars), F.lit(0))
    digests = F.transform(F.filter(F.transform(found, lambda p: F.trim(p)), lambda p: p != ""), lambda p: F.xxhash64(p))
    return F.array_sort(F.array_distinct(digests))


def _place(key: Column, table: int, width: Column) -> Column:
    return (F.pmod(F.xxhash64(key, F.lit(table)), width) + table * width).cast("int")


def _check(key: Column) -> Column:
    return F.xxhash64(key, F.lit("check"))


def _cells(keys: DataFrame, by: list[str]) -> DataFrame:
    """(by..., width, cell, n, key, sum) of rows (by..., width, sign, key): sketches, or differences of sketches.

    A row of sign 0 stands for its whole sketch and becomes the cell -1, so a sketch where all cancels is still told.
    """
    whole, width = F.col("sign") == 0, F.col("width")
    places = F.when(whole, F.array(F.lit(-1))).otherwise(F.array(*[_place(F.col("key"), t, width) for t in range(TABLES)]))
    entered = keys.select(
        *by, "width", F.explode(places).alias("cell"), F.when(whole, 1).otherwise(F.col("sign")).cast("long").alias("n"), "key",
        F.when(whole, 0).otherwise(_check(F.col("key"))).cast("long").alias("sum"),
    )
    return _added(entered, by)


def _signed(left: Column, right: Column | None = None) -> Column:
    """Digests as rows for ``_cells``: those of the right side are taken away."""
    row = lambda sign, key: F.struct(F.lit(sign).cast("long").alias("sign"), key.cast("long").alias("key"))
    parts = [F.array(row(0, F.lit(0))), F.transform(left, lambda k: row(1, k))]
    return F.concat(*parts, *([] if right is None else [F.transform(right, lambda k: row(-1, k))]))


def _added(cells: DataFrame, by: list[str]) -> DataFrame:
    """Cells of equal place added up, without those where nothing is left."""
    sums = cells.groupBy(*by, "width", "cell").agg(F.sum("n").alias("n"), F.bit_xor("key").alias("key"), F.bit_xor("sum").alias("sum"))
    return sums.filter((F.col("n") != 0) | (F.col("key") != 0) | (F.col("sum") != 0))


def _peeled(cells: DataFrame, by: list[str]) -> DataFrame:
    """The cells after peeling; each digest that was recovered adds one to the cell -1, others that are left tell a failure.

    A pass looks at one of the three tables, where each digest has a single cell, so none is taken twice.
    """
    width = F.col("width")
    found = F.struct(F.lit(-1).alias("cell"), *[F.lit(v).cast("long").alias(name) for name, v in (("n", 1), ("key", 0), ("sum", 0))])
    for _ in range(ROUNDS):
        for table in range(TABLES):
            inside = (F.col("cell") >= table * width) & (F.col("cell") < (table + 1) * width)
            alone = inside & (F.abs("n") == 1) & (F.col("sum") == _check(F.col("key")))
            taken = [
                F.struct(_place(F.col("key"), other, width).alias("cell"), (-F.col("n")).alias("n"), "key", "sum")
                for other in range(TABLES) if other != table
            ]
            moved = F.when(alone, F.array(found, *taken)).otherwise(F.array(F.struct("cell", "n", "key", "sum")))
            cells = _added(cells.select(*by, "width", F.inline(moved)), by)
    return cells


def _bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """``df`` stored in buckets of ``key`` in the shared folder, so that grouping by it needs no further exchange."""
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/tables/{table}"
    df.repartition(buckets, key).write.bucketBy(buckets, key).option("path", path).saveAsTable(table)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return spark.table(table)


def differing(versions: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(row, pair, n_left, n_right, differing): how many digests stand on one side only, by subtracted sketches.

    ``versions`` has a unique row and arrays of distinct digests; ``pairs`` names two of them each, and numbers
    the results. Sketches of a fingerprint's width are compared first. Where a difference doesn't
    peel whole, wider sketches are made of the digests, with room for all of them, then twice
    that, until none is left. ``versions`` is best stored in buckets of row: then no cell is exchanged.
    """
    by, done, sides = ["row", "pair", "n_left", "n_right"], [], [F.struct(F.lit(i).alias("pair"), F.col(a).alias("left"), F.col(b).alias("right")) for i, (a, b) in enumerate(pairs)]
    tried = versions.select("row", F.inline(F.array(*sides)))
    width, attempt = F.lit(WIDTH), 0
    while True:
        keyed = tried.select(
            "row", "pair", F.size("left").cast("long").alias("n_left"), F.size("right").cast("long").alias("n_right"), width.cast("int").alias("width"), F.inline(_signed(F.col("left"), F.col("right")))
        )
        peeled = _peeled(_cells(keyed, by), by).groupBy(*by).agg(
            (F.sum(F.when(F.col("cell") == -1, F.col("n")).otherwise(0)) - 1).alias("differing"), F.sum((F.col("cell") >= 0).cast("long")).alias("stuck")
        )
        result = work_table(peeled, "peeled")
        done.append(result.filter("stuck = 0").drop("stuck"))
        failed = result.filter("stuck > 0").groupBy("row").agg(F.collect_set("pair").alias("failed"))
        if failed.isEmpty():
            break
        again = versions.join(failed, "row").withColumn("_sides", F.filter(F.array(*sides), lambda s: F.array_contains("failed", s["pair"])))
        tried = again.select("row", F.inline("_sides"))
        width = F.ceil((F.size("left") + F.size("right")) * F.lit(SPARE * 2**attempt / TABLES)) + WIDTH
        attempt += 1
    union = done[0]
    for other in done[1:]:
        union = union.unionByName(other)
    return union


def likeness(n_left: Column, n_right: Column, differing: Column) -> Column:
    """Shared digests as a share of all; 1 for two texts without any."""
    return F.when(n_left + n_right == 0, 1.0).otherwise((n_left + n_right - differing) / (n_left + n_right + differing))


def _strings(versions: DataFrame, names: list[str]) -> DataFrame:
    """(row, fingerprint per name): number of digests, then every cell that isn't empty, in hexadecimal digits."""
    sides = F.inline(F.array(*[F.struct(F.lit(i).alias("side"), F.col(n).alias("digests")) for i, n in enumerate(names)]))
    keyed = versions.select("row", sides).select("row", "side", F.lit(WIDTH).alias("width"), F.inline(_signed(F.col("digests"))))
    digits = lambda c, n: F.lpad(F.lower(F.hex(c)), n, "0")
    cells = _cells(keyed, ["row", "side"]).filter("cell >= 0")
    text = F.concat(digits(F.col("cell").cast("long"), 2), digits(F.col("n"), 6), digits(F.col("key"), 16), digits(F.col("sum"), 16))
    per_row = cells.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("side", "cell", text.alias("text")))).alias("cells"))

    def told(i: int) -> Column:
        return F.array_join(F.transform(F.filter("cells", lambda c: c["side"] == i), lambda c: c["text"]), ".")

    return per_row.select("row", *[told(i).alias(n) for i, n in enumerate(names)])


def _with_next(docs: DataFrame) -> DataFrame:
    """Rows (id, text) with digests, next_text and next_digests: of the next row by id and text, after the last the first.

    Rows are dealt to even ranges of ids, and each range also gets the first row of the one after it.
    """
    spark = docs.sparkSession
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.withColumn("_key", F.coalesce(F.col("id").cast("double"), F.lit(-1e308)))
    ranges = QuantileDiscretizer(numBuckets=parts, inputCol="_key", outputCol="part", relativeError=1 / (4 * parts)).fit(keyed.select("_key"))
    ranged = ranges.transform(keyed).drop("_key")
    firsts = ranged.groupBy("part").agg(F.min(F.struct(F.col("id").isNotNull().alias("told"), "id"))["id"].alias("id"))  # a row a range
    first_rows = ranged.join(F.broadcast(firsts.select(F.col("part").alias("_part"), F.col("id").alias("_id"))), F.expr("part = _part and id <=> _id"))
    first_texts = first_rows.groupBy("part").agg(F.min("text").alias("text"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.lag("part").over(Window.orderBy("part")), F.last("part").over(order))  # over a row a range
    guests = first_texts.select(before.alias("part"), F.lit(None).cast(docs.schema["id"].dataType).alias("id"), "text", F.lit(True).alias("guest"))
    both = ranged.select("part", "id", "text", F.lit(False).alias("guest")).unionByName(guests)
    both = both.withColumn("digests", paragraph_digests(F.col("text")))
    ahead = Window.partitionBy("part").orderBy("guest", F.asc_nulls_first("id"), "text")
    paired = both.withColumns({"next_text": F.lead("text").over(ahead), "next_digests": F.lead("digests").over(ahead)})
    return paired.filter(~F.col("guest")).drop("part", "guest")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The edited text has its second half, rounded down, replaced by as many characters from the beginning of the next
    row's text, by ascending id, equal ids by text; after the last row comes the first. Ids are integers; null ones come first.
    A fingerprint depends on the text alone: ``3 * WIDTH`` cells of its paragraphs' digests (``paragraph_digests``).
    Likeness is the share of paragraphs that two texts have in common, by peeling their subtracted sketches,
    and 1 for two texts without paragraphs. Null and blank texts have no paragraphs; a null text counts
    as empty. Repeated rows each give a row. An empty table gives none. Other columns are left out.
    """
    chosen = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    if chosen.isEmpty():
        paired = chosen.withColumns({"digests": F.array().cast("array<bigint>"), "next_text": F.lit(""), "next_digests": F.array().cast("array<bigint>")})
    else:
        paired = _with_next(chosen)
    n_chars = F.length("text").cast("long")
    half = F.floor(n_chars / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (n_chars - half).cast("int")), F.substring("next_text", F.lit(1), half))
    told = paired.withColumn("edited", edited).select(
        F.monotonically_increasing_id().alias("row"), "id", n_chars.alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        F.col("digests").alias("own"), paragraph_digests(F.col("edited")).alias("edited"), F.col("next_digests").alias("next"),
    )
    versions = _bucketed(told, "row", "versions")
    near = differing(versions, [("own", "edited"), ("own", "next")])
    value = likeness(F.col("n_left"), F.col("n_right"), F.col("differing"))
    sides = near.groupBy("row").agg(*[F.max(F.when(F.col("pair") == i, value)).alias(n) for i, n in enumerate(("near_edited", "near_next"))])
    text = _strings(versions, ["own", "edited"]).select("row", F.col("own").alias("_own"), F.col("edited").alias("_edited"))
    joined = versions.join(text, "row", "left").join(sides, "row")
    count = lambda name, cells: F.concat(F.lower(F.hex(F.size(name).cast("long"))), F.lit(":"), F.coalesce(F.col(cells), F.lit("")))
    return joined.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", count("own", "_own").alias("fingerprint"), count("edited", "_edited").alias("edited_fingerprint"), "near_edited", "near_next"
    )
