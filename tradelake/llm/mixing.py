"""Mixing of sources to target weights by a multivariate-hypergeometric splitting tree. DataFrame operations only.

Texts are cut in blocks of BLOCK words. Each source's target number of words becomes whole copies of
all its blocks and a rest, drawn without replacement in the order of a hash of (seed, row, block): the
blocks' running words in that order are summed by hash ranges, of which there are more the more blocks
there are, so that no source is gathered or sorted in one place. The blocks drawn of all sources are
then dealt to output shards by a tree: each node splits the exact numbers of blocks it has of each
source between its halves by a multivariate hypergeometric draw, a chain of hypergeometric ones: by
inverting the distribution within 12 standard deviations, or, where the deviation is over 700, by
rejection from a table-mountain hat (ratio of uniforms). A shard takes the disjoint range of each
source's permuted blocks that its quota names, and orders its blocks by hash.

Results for unusual input: null or blank texts have size 0 and no block; a null source is a source of
its own that comes last; sources without words have target 0. Rows of one doc_id, rows without one and
equal rows are rows of their own, with blocks of their own; of equal rows it is undefined which is which.
Results depend on the rows and the seed alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import anchors, scratch

BLOCK = 128
#: Blocks in a hash range, about, by which the permuted blocks of a source are summed; at least LEAST_RANGES of them.
RANGE_BLOCKS, LEAST_RANGES = 1 << 17, 1024
#: A row's name: its id (0 for null), a hash of what it holds, and its number among equal rows.
ROW = ["id", "sig", "nth"]
WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
#: Words of an output shard, about.
SHARD_WORDS = 1 << 23
#: Standard deviation of a draw from which it is made by rejection.
LARGE = 700
WORDS = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame) -> DataFrame:
    """src, source_size, target from one row for each source (src ordered as the weights go, source_size)."""
    order = Window.orderBy("src")
    weighed = sizes.withColumn("_i", (F.row_number().over(order) - 1) % len(WEIGHTS))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in WEIGHTS)), (F.col("_i") + 1).cast("int"))
    weighed = weighed.withColumn("w", weight).withColumn("cap", MOST_COPIES * F.col("source_size").cast("double"))
    # sources that reach their cap are those of the least cap for their weight; `level` is what one unit of weight gets if they do
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), "src")
    all_rows = Window.partitionBy()
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(all_rows) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    levelled = weighed.withColumn("_level", level).withColumn("_free", F.col("_level") * F.col("w") <= F.col("cap"))
    found = levelled.withColumn("_found", F.min(F.when(F.col("_free"), F.struct((F.col("cap") / F.col("w")).alias("r"), "src", F.col("_level").alias("level")))).over(all_rows))
    return found.select("src", "source_size", F.coalesce(F.least("cap", F.col("_found.level") * F.col("w")), F.col("cap")).alias("target"))


def _lgamma(x: str) -> str:
    """SQL for the logarithm of the gamma function of a large number, by Stirling's series."""
    return f"(({x} - 0.5D) * ln({x}) - {x} + 0.9189385332046728D + 1 / (12D * {x}) - 1 / (360D * {x} * {x} * {x}))"


def _rejection(key: str, tries: int = 100) -> str:
    """SQL for a hypergeometric draw from p.pop, p.good, p.drawn by ratio of uniforms; each try is taken with a chance of about 3 in 4."""
    uniform = lambda k: f"((pmod(xxhash64({key}, {k}, i), 9007199254740881) + 0.5D) / 9007199254740881D)"
    weight = lambda z: " + ".join(_lgamma(x) for x in (f"({z} + 1D)", f"(a.few - {z} + 1D)", f"(a.m - {z} + 1D)", f"(a.many - a.m + {z} + 1D)"))
    one = lambda name, fields, body: f"transform(array(named_struct({fields})), {name} -> {body})[0]"
    z_of = f"transform(sequence(0, {tries - 1}), i -> transform(array(named_struct('x', {uniform(1)}, 'y', {uniform(2)})), v -> named_struct('x', v.x, 'w', b.mean + b.wide * (v.y - 0.5D) / v.x))[0])"
    good = f"c -> c.w >= 0 and c.w < b.most and 2 * ln(c.x) <= b.top - ({weight('floor(c.w)')})"
    drawn = f"coalesce(try_element_at(transform(filter({z_of}, {good}), c -> floor(c.w) + 0D), 1), b.mode)"
    scaled = one("b", f"'mean', a.m * a.few / p.pop + 0.5D, 'wide', 1.7155277699214135D * a.s + 0.8989161620588988D, 'mode', a.mode, 'most', least(least(a.m, a.few) + 1, floor(a.m * a.few / p.pop + 0.5D + 16 * a.s)), 'top', {weight('a.mode')}", drawn)
    sized = "'m', least(p.drawn, p.pop - p.drawn), 'few', least(p.good, p.pop - p.good), 'many', greatest(p.good, p.pop - p.good)"
    moments = one("a", "'m', e.m, 'few', e.few, 'many', e.many, 'mode', floor((e.m + 1) * (e.few + 1) / (p.pop + 2)) + 0D, 's', sqrt((p.pop - e.m) * e.m / (p.pop - 1) * (e.few / p.pop) * (1 - e.few / p.pop) + 0.5D)", scaled)
    few_of_m = one("e", sized, moments)
    # from few among m back to good among drawn
    back = one("g", f"'z', {few_of_m}", "if(p.good > p.pop - p.good, least(p.drawn, p.pop - p.drawn) - g.z, g.z)")
    return one("h", f"'z', {back}", "if(p.drawn > p.pop - p.drawn, p.good - h.z, h.z)")


def hypergeometric(big_n: str, big_k: str, n: str, key: str) -> str:
    """SQL for how many of K marked among N are in a draw of n (all doubles), drawn by a hash of key."""
    u = f"(pmod(xxhash64({key}), 9007199254740881) + 0.5D) / 9007199254740881D"
    body = f"""
      transform(array(named_struct('pop', cast({big_n} as double), 'good', cast({big_k} as double), 'drawn', cast({n} as double), 'u', {u})), p ->
        case when p.pop <= 0 or p.good <= 0 or p.drawn <= 0 then 0D when p.drawn >= p.pop then p.good when p.good >= p.pop then p.drawn else
          transform(array(named_struct('m', p.drawn * p.good / p.pop, 's', sqrt(greatest(0D, p.drawn * p.good / p.pop * (1 - p.good / p.pop) * (p.pop - p.drawn) / greatest(1D, p.pop - 1))), 'lo', greatest(0D, p.drawn - (p.pop - p.good)), 'hi', least(p.drawn, p.good))), q ->
            case when q.s > {LARGE} then {_rejection(key)}
            else transform(array(named_struct('a', floor(greatest(q.lo, q.m - 12 * q.s - 2)), 'b', ceil(least(q.hi, q.m + 12 * q.s + 2)))), r ->
              aggregate(sequence(cast(r.a as bigint), cast(r.b as bigint)),
                named_struct('x', cast(r.a as double), 'w', 1D, 'c', 0D,
                  't', p.u * aggregate(sequence(cast(r.a as bigint), cast(r.b as bigint)), named_struct('w', 1D, 'c', 0D),
                    (z, k) -> named_struct('w', z.w * (p.good - k) * (p.drawn - k) / ((k + 1D) * (p.pop - p.good - p.drawn + k + 1D)), 'c', z.c + z.w), z -> z.c)),
                (z, k) -> named_struct('x', if(z.c < z.t, cast(k as double), z.x), 'w', z.w * (p.good - k) * (p.drawn - k) / ((k + 1D) * (p.pop - p.good - p.drawn + k + 1D)), 'c', z.c + z.w, 't', z.t),
                z -> z.x))[0] end)[0] end)[0]"""
    return " ".join(body.split())


def shard_quotas(counts: DataFrame, shards: int, seed: int) -> DataFrame:
    """src, upto: for each source the running numbers of its blocks after each shard. counts: src, blocks. shards: a power of two."""
    nodes = counts.agg(F.array_sort(F.collect_list(F.struct("src", F.col("blocks").cast("double").alias("blocks")))).alias("q")).select(F.lit(0).alias("node"), "q")
    width = shards
    while width > 1:
        total = "aggregate(q, 0D, (s, x) -> s + x.blocks)"
        draw = hypergeometric("s.total", "x.blocks", "s.room", f"{seed}, {width}, node, x.src")
        split = f"""aggregate(q, named_struct('total', {total}, 'room', floor({total} / 2 + 0.5 * (node % 2)) + 0D, 'out', cast(array() as array<double>)),
            (s, x) -> transform(array({draw}), d -> named_struct('total', s.total - x.blocks, 'room', s.room - d, 'out', concat(s.out, array(d))))[0], s -> s.out)"""
        nodes = nodes.withColumn("left", F.expr(" ".join(split.split())))
        halves = F.array(
            F.struct((F.col("node") * 2).alias("node"), F.expr("zip_with(q, left, (x, d) -> named_struct('src', x.src, 'blocks', d))").alias("q")),
            F.struct((F.col("node") * 2 + 1).alias("node"), F.expr("zip_with(q, left, (x, d) -> named_struct('src', x.src, 'blocks', x.blocks - d))").alias("q")),
        )
        nodes = scratch.written(nodes.select(F.explode(halves).alias("h")).select("h.*"))
        width //= 2
    each = nodes.select("node", F.explode("q").alias("x")).select("node", "x.src", "x.blocks")
    upto = F.sum("blocks").over(Window.partitionBy("src").orderBy("node"))
    return each.withColumn("upto", upto).groupBy("src").agg(F.transform(F.array_sort(F.collect_list(F.struct("node", F.col("upto").cast("long").alias("upto")))), lambda x: x["upto"]).alias("upto"))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, id, sig, nth (the row's name), src (source with a leading s, or t for null, so that it sorts by code point with null last), size; a written table."""
    src = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("t"))
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORDS)).cast("long")
    rows = scratch.written(docs.select("doc_id", *named(docs), src.alias("src"), size.alias("size"), F.spark_partition_id().alias("part")))
    # equal rows are numbered part by part, so that a large group of them is not sorted in one place
    parts = rows.groupBy("id", "sig", "part").agg(F.count("*").alias("n"))
    more = rows.groupBy("id", "sig").agg(F.count("*").alias("all")).where("all > 1").select("id", "sig")
    before = F.sum("n").over(Window.partitionBy("id", "sig").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = scratch.written(parts.join(more, ["id", "sig"], "left_semi").select("id", "sig", "part", F.coalesce(before, F.lit(0)).alias("before")))
    few = F.broadcast(offsets) if offsets.count() <= anchors.BROADCAST_IDS else offsets
    place = F.row_number().over(Window.partitionBy("id", "sig", "part").orderBy("size")) - 1
    again = rows.join(few, ["id", "sig", "part"]).withColumn("nth", F.col("before") + place)
    once = rows.join(few, ["id", "sig", "part"], "left_anti").withColumn("nth", F.lit(0).cast("long"))
    columns = ["doc_id", *ROW, "src", "size"]
    return scratch.written(once.select(*columns).unionByName(again.select(*columns)))


def named(docs: DataFrame) -> list[Column]:
    """id and sig of each row of docs."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.xxhash64(F.col("doc_id").isNull(), F.col("source").isNull(), "source", F.col("text").isNull(), "text").alias("sig")]


def mixed(rows: DataFrame, sources: DataFrame, shards: int = 16, seed: int = 1) -> DataFrame:
    """shard, place (order in the shard), id, sig, nth, block, copy, words: every block the mix takes, each copy a row.

    rows: as sized() gives them; sources: src, source_size, target.
    """
    parts = F.expr(f"sequence(0L, (size - 1) div {BLOCK})")
    some = rows.where("size > 0")
    ranges = LEAST_RANGES
    most = some.groupBy("src").agg(F.sum(F.expr(f"(size - 1) div {BLOCK} + 1")).alias("n")).agg(F.max("n")).first()[0] or 0
    while ranges * RANGE_BLOCKS < most:
        ranges *= 2
    blocks = some.select(*ROW, "src", "size", F.explode(parts).alias("block"))
    blocks = blocks.select(*ROW, "src", "block", F.least(F.lit(BLOCK).cast("long"), F.col("size") - F.col("block") * BLOCK).alias("words"), F.xxhash64(F.lit(seed), *ROW, "block").alias("h"))
    blocks = blocks.withColumn("range", F.shiftrightunsigned("h", 64 - ranges.bit_length() + 1).cast("long"))
    sums = blocks.groupBy("src", "range").agg(F.sum("words").alias("w"), F.count("*").alias("n"))
    earlier = Window.partitionBy("src").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("src", "range", F.coalesce(F.sum("w").over(earlier), F.lit(0)).alias("w0"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"), F.sum("n").over(Window.partitionBy("src")).alias("n_all"))
    inner = Window.partitionBy("src", "range").orderBy(F.col("h") >= 0, "h", *ROW, "block")
    ranked = blocks.withColumn("w1", F.sum("words").over(inner.rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")).withColumn("n1", F.row_number().over(inner) - 1)
    whole = F.floor(F.col("target") / F.col("source_size"))
    plan = sources.where("source_size > 0").select("src", whole.alias("whole"), (F.col("target") - whole * F.col("source_size")).alias("rest"))
    placed = ranked.join(sums, ["src", "range"]).join(plan, "src")
    placed = placed.withColumn("rank", F.col("n0") + F.col("n1")).withColumn("copies", F.col("whole") + (F.col("w0") + F.col("w1") + F.col("words") / 2 <= F.col("rest")).cast("long"))
    placed = scratch.written(placed.where("copies > 0").select(*ROW, "src", "block", "words", "h", "rank", "n_all", "copies"))
    counts = placed.groupBy("src").agg(F.sum("copies").alias("blocks"))
    quotas = shard_quotas(counts, shards, seed)
    items = placed.join(quotas, "src").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    # the copies of a source's blocks stand one whole round after the other; drawn blocks are the least of the permutation
    at = F.col("copy") * F.col("n_all") + F.col("rank")
    items = items.withColumn("at", at)
    # how many of the running numbers `at` has reached, by binary search
    steps = F.sequence(F.lit(shards.bit_length() - 2), F.lit(0), F.lit(-1)) if shards > 1 else F.array().cast("array<int>")
    shard = F.expr("aggregate(steps, 0, (p, k) -> if(upto[p + shiftleft(1, k) - 1] <= at, p + shiftleft(1, k), p))")
    items = items.withColumn("steps", steps)
    return items.select(shard.alias("shard"), F.xxhash64(F.lit(seed + 1), "h", "copy").alias("place"), *ROW, "block", "copy", "words")


def source_targets(rows: DataFrame) -> DataFrame:
    """src, source_size, target of each source of sized() rows; a written table."""
    return scratch.written(targets(rows.groupBy("src").agg(F.sum("size").alias("source_size"))))


def shards_for(sources: DataFrame) -> int:
    """A power of two of shards, of about SHARD_WORDS words each."""
    words = sources.agg(F.sum("target")).first()[0] or 0
    return 1 << max(4, int(words / SHARD_WORDS).bit_length())


def digest(docs: DataFrame, shards: int = 16, seed: int = 1) -> DataFrame:
    """doc_id, size, source_size, target, taken (words of the mix from the row, repeats counted), n_shards."""
    rows = sized(docs)
    sources = source_targets(rows)
    taken = mixed(rows, sources, shards, seed).groupBy(*ROW).agg(F.sum("words").alias("taken"), F.countDistinct("shard").alias("n_shards"))
    out = rows.join(sources, "src").join(taken, ROW, "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("n_shards", F.lit(0)).cast("long").alias("n_shards"))


def corpus(docs: DataFrame, shards: int | None = None, seed: int = 1) -> DataFrame:
    """The mix itself: shard, place, doc_id, source, block, copy, words, text (of the block: its words, one space between), in order within each shard.

    A row for each block taken and each copy of it; rows of which nothing is taken have none. shards: a power of two.
    """
    rows = sized(docs)
    sources = source_targets(rows)
    shards = shards or shards_for(sources)
    drawn = mixed(rows, sources, shards, seed)
    lists = drawn.groupBy(*ROW).agg(F.collect_list(F.struct("shard", "place", "block", "copy", "words")).alias("blocks"))
    texts = docs.select("doc_id", *named(docs), "source", "text")
    # of equal rows one gives the text of all
    again = scratch.written(rows.where("nth > 0").select("id", "sig").distinct())
    few = F.broadcast(again) if again.count() <= anchors.BROADCAST_IDS else again
    texts = texts.join(few, ["id", "sig"], "left_anti").unionByName(texts.join(few, ["id", "sig"], "left_semi").dropDuplicates(["id", "sig"]))
    # the words are found once a text, and each block's are joined before the blocks are dealt out
    cut = f"""transform(array(regexp_extract_all(text, '({WORDS})', 1)), w -> transform(blocks, b ->
        named_struct('shard', b.shard, 'place', b.place, 'block', b.block, 'copy', b.copy, 'words', b.words, 'text', array_join(slice(w, cast(b.block * {BLOCK} + 1 as int), {BLOCK}), ' '))))[0]"""
    out = lists.join(texts, ["id", "sig"]).select("doc_id", "source", F.explode(F.expr(cut.replace("\\", "\\\\"))).alias("b")).select("b.shard", "b.place", "doc_id", "source", "b.block", "b.copy", "b.words", "b.text")
    return out.repartition(shards, "shard").sortWithinPartitions("shard", "place")
