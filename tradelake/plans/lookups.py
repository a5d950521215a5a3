"""Queries of searches and reference lookups: part is the tariff, nations are banks and countries, orders print payment terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import cells as c
from ..operators.relational import best_row
from ..sources.tables import read
from .resolution import _TARIFF, _tariff

#: Tokens of a query that count, and results of one.
MOST_TOKENS, MOST_RESULTS = 12, 10


def starts(token: Column, least: int) -> Column:
    """All beginnings of a token of at least `least` characters."""
    return F.transform(F.sequence(F.lit(least), F.greatest(F.lit(least), F.char_length(token))), lambda n: F.substring(token, F.lit(1), n))


def token_matches(asked: DataFrame, known: DataFrame) -> DataFrame:
    """q, w, level (tenths: 10 equal, 8 q begins w, 6 q of four characters or more stands in w) from tokens asked (q) and known (w), each distinct.

    Beginnings and inner parts are dealt by equality: no token is compared with all others.
    """
    inner = F.flatten(F.transform(F.sequence(F.lit(1), F.char_length("w")), lambda i: F.transform(F.sequence(F.lit(4), F.greatest(F.lit(4), F.char_length("w") - i + 1)), lambda n: F.substring("w", i, n))))
    parts = known.select("w", F.explode(starts(F.col("w"), 1)).alias("q"), F.lit(8).alias("level"))
    parts = parts.unionByName(known.where("char_length(w) > 4").select("w", F.explode(F.array_distinct(inner)).alias("q"), F.lit(6).alias("level")).where("char_length(q) >= 4"))
    parts = parts.select("q", "w", F.when(F.col("q") == F.col("w"), 10).otherwise(F.col("level")).alias("level"))
    return asked.join(parts, "q").groupBy("q", "w").agg(F.max("level").alias("level"))


def search(queries: DataFrame, records: DataFrame, most: int = MOST_RESULTS) -> DataFrame:
    """id, code, score, place: the records (code, text) best for each query (id, text). Every token must match; the mean of the best levels, in tenths of a percent."""
    asked = queries.select("id", F.slice(c.search_tokens(F.col("text")), 1, MOST_TOKENS).alias("t")).select("id", F.size("t").alias("n"), F.posexplode("t").alias("i", "q"))
    words = records.select("code", F.explode(F.array_distinct(c.search_tokens(F.col("text")))).alias("w"))
    levels = token_matches(asked.select("q").distinct(), words.select("w").distinct())
    best = levels.join(words, "w").groupBy("q", "code").agg(F.max("level").alias("level"))
    scored = asked.join(best, "q").groupBy("id", "n", "code").agg(F.count("*").alias("met"), F.sum("level").alias("all")).where("met = n")
    score = F.round(F.col("all").cast("decimal(18,4)") * 100 / F.col("n"), 0).cast("long")
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "code"))
    return scored.select("id", "code", score.alias("score")).withColumn("place", place).where(F.col("place") <= most)  # the first results are what is asked for


def _search_text(s, d):
    """Part names cut to beginnings and inner parts of their words, searched in the tariff's descriptions."""
    words = F.split("p_name", " ")
    names = read(s, d, "part").select("p_name").distinct()
    asked = names.select(F.col("p_name").alias("id"), F.concat_ws(" ", F.substring(words[0], 1, 3), F.substring(words[1], 2, 9)).alias("text"))
    return search(asked, _tariff(s, d).select("code", F.col("description").alias("text")))


def _search_number(s, d):
    """Printed digits, in part with separators, searched as beginnings of tariff codes; the whole code comes first."""
    t = _tariff(s, d).select("code")
    k = F.col("p_partkey")
    raw = F.when(k % 3 == 0, F.col("code")).when(k % 3 == 1, F.concat_ws(".", F.substring("code", 1, 4), F.substring("code", 5, 4))).otherwise(F.substring("code", 1, 6))
    asked = _tariff(s, d).select("p_partkey", c.digits_only(raw).alias("digits"))
    # of the codes with one beginning the whole one is the least, so the first ones in order are the best of them
    first = F.row_number().over(Window.partitionBy("digits").orderBy("code"))
    keys = t.select("code", F.explode(starts(F.col("code"), 2)).alias("digits")).withColumn("first", first).where(F.col("first") <= MOST_RESULTS).drop("first")
    score = F.when(F.col("code") == F.col("digits"), 100).otherwise(90)
    place = F.row_number().over(Window.partitionBy("p_partkey").orderBy(F.desc("score"), "code"))
    # ten beginnings of each code are more than the table's size tells, so they are not broadcast
    found = asked.join(keys.hint("merge"), "digits").select("p_partkey", "code", score.alias("score"))
    return found.withColumn("place", place).where(F.col("place") <= MOST_RESULTS)  # the first results are what is asked for


def word_meets(asked: DataFrame, known: DataFrame) -> DataFrame:
    """q, w of the tokens asked (q) and known (w), each distinct, that are equal or of which one of four characters or more begins the other."""
    begun = known.select("w", F.explode(starts(F.col("w"), 4)).alias("q")).join(asked, "q").select("q", "w")
    begins = asked.select("q", F.explode(starts(F.col("q"), 4)).alias("w")).join(known, "w").select("q", "w")
    return begun.unionByName(begins).distinct()


def points_met(asked: DataFrame, kinds: DataFrame) -> DataFrame:
    """The columns of asked but q, and those of kinds but d and e, with points, for what shares a band and a word: 2 for each word of q that meets one of d, else 1 for one of e.

    asked: band, q. kinds: band, d, e. Words are dealt by equality and points added up: a list is not compared with all others of its band.
    """
    own, others = [x for x in asked.columns if x != "q"], [x for x in kinds.columns if x not in ("d", "e")]
    words = asked.select(*own, F.explode("q").alias("q")).groupBy(*own, "q").agg(F.count("*").alias("times"))
    pairs = lambda x, k: F.transform(x, lambda w: F.struct(w.alias("w"), F.lit(k).alias("level")))
    known = kinds.select(*others, F.explode(F.concat(pairs(F.col("d"), 2), pairs(F.col("e"), 1))).alias("x")).select(*others, "x.*")
    meets = word_meets(words.select("q").distinct(), known.select("w").distinct())
    levels = known.join(meets, "w").groupBy(*others, "q").agg(F.max("level").alias("level"))
    return words.join(levels.hint("merge"), ["band", "q"]).groupBy(*own, *(x for x in others if x != "band")).agg(F.sum(F.col("times") * F.col("level")).alias("points"))


def _band_pick(s, d):
    """Of the tariff codes that share four digits with an item's, the one that covers its words best (official description 1, explanation a half); below 0.34 the last code called Other, else the last."""
    t = _tariff(s, d).join(read(s, d, "part").select("p_partkey", F.col("p_brand").alias("explanation")).hint("merge"), "p_partkey")
    t = t.withColumn("other", F.col("p_partkey") % 7 == 0).withColumn("description", F.when(F.col("other"), "Other").otherwise(F.col("description"))).withColumn("band", F.substring("code", 1, 4))
    words = lambda x: F.array_sort(F.array_distinct(c.meaningful_tokens(F.col(x))))
    t = t.select("code", "band", "other", words("description").alias("d"), words("explanation").alias("e"))
    asked = _tariff(s, d).select("p_partkey", F.substring("code", 1, 4).alias("band"), F.array_join(F.array_sort(c.meaningful_tokens(F.col("description"))), " ").alias("words"))
    # items of a band with equal words are asked for once, and of codes with equal words the first can be the best
    lists = asked.select("band", "words").distinct().withColumn("q", F.expr("filter(split(words, ' '), x -> x <> '')"))
    kinds = t.groupBy("band", "d", "e").agg(F.min(F.struct("other", "code")).alias("best")).select("band", "d", "e", F.concat_ws("|", F.array_join("d", " "), F.array_join("e", " ")).alias("kind"), "best.*")
    last = t.groupBy("band").agg(F.max(F.struct("other", "code", "d", "e")).alias("last")).select("band", "last.*")
    n = F.greatest(F.lit(1), F.size("q"))
    hits = points_met(lists.withColumn("n", n), kinds).where("points * 50 >= n * 34").select("band", "words", "code", "other", "points", F.lit(True).alias("hit"))
    fallen = lists.select("band", "words").join(last.select("band", "code", "other"), "band").join(points_met(lists, last.drop("other", "code")).hint("merge"), ["band", "words"], "left")
    fallen = fallen.select("band", "words", "code", "other", F.coalesce("points", F.lit(0)).alias("points"), F.lit(False).alias("hit"))
    order = [F.desc("hit"), F.when(F.col("hit"), -F.col("points")), F.when(F.col("hit"), F.col("other")).otherwise(~F.col("other")), F.when(F.col("hit"), F.col("code")), F.desc("code")]
    best = best_row(hits.unionByName(fallen), ["band", "words"], order)
    x = best_row(asked.join(best.hint("merge"), ["band", "words"]), ["p_partkey"], order)
    return x.select("p_partkey", "code", F.col("points").cast("long").alias("half_points"), (~F.col("hit")).alias("fallback"))


#: Characters by which names that hold one another are dealt.
GRAM = 6


def _bank(s, d):
    """A printed SWIFT code and bank name resolved: whole code, its first eight, these with XXX, a stored code's first eight, the name, then a name that holds the other."""
    swift = F.upper(F.substring(F.md5(F.col("n_name")), 1, 8))
    known = read(s, d, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 3 == 0, F.concat(swift, F.lit("XXX"))).when(F.col("n_nationkey") % 3 == 1, F.concat(swift, F.lit("KTM"))).otherwise(swift).alias("stored"), c.text_key(F.concat(F.col("n_name"), F.lit(" bank"))).alias("name_key"))
    nation = read(s, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    k = F.col("s_suppkey") % 6
    base = F.upper(F.substring(F.md5(F.col("n_name")), 1, 8))
    x = read(s, d, "supplier").join(F.broadcast(nation), "s_nationkey")
    printed = F.when(k == 0, F.lower(base)).when(k == 1, F.concat(base, F.lit("ABC"))).when(k == 2, "NOSUCHXX")
    name = F.when(k == 3, F.concat(F.initcap("n_name"), F.lit(" Bank."))).when(k == 4, F.concat(F.col("n_name"), F.lit(" bank limited"))).when(k == 5, "xyz")
    x = x.select("s_suppkey", F.upper(F.trim(printed)).alias("base"), c.text_key(name).alias("key"))
    b8 = F.substring("base", 1, 8)
    rungs = [(F.explode(F.array(F.struct(F.lit(1).alias("rung"), F.col("base").alias("stored")), F.struct(F.lit(2).alias("rung"), b8.alias("stored")), F.struct(F.lit(3).alias("rung"), F.concat(b8, F.lit("XXX")).alias("stored")))), known.select("n_nationkey", "stored"))]
    found = x.where("base is not null").select("s_suppkey", rungs[0][0].alias("r")).select("s_suppkey", "r.rung", "r.stored").join(rungs[0][1], "stored").select("s_suppkey", "rung", "n_nationkey")
    eight = x.where("base is not null").select("s_suppkey", b8.alias("e")).join(known.select("n_nationkey", F.substring("stored", 1, 8).alias("e")), "e").select("s_suppkey", F.lit(4).alias("rung"), "n_nationkey")
    named = x.where("key <> ''").join(known.select("n_nationkey", F.col("name_key").alias("key")), "key").select("s_suppkey", F.lit(5).alias("rung"), "n_nationkey")
    early = found.unionByName(eight).unionByName(named)
    # only what no rung before resolved goes on; a name that holds another one holds its first GRAM characters, by which they are dealt
    rest = x.where(F.char_length("key") > 5).join(early.select("s_suppkey").distinct(), "s_suppkey", "left_anti").select("s_suppkey", "key")
    pieces = lambda text, sizes: F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.char_length(text)), lambda i: F.transform(F.array(*map(F.lit, sizes)), lambda n: F.substr(text, i, n)))))).alias("gram")
    within = rest.select("s_suppkey", "key", pieces(F.col("key"), range(1, GRAM + 1))).join(known.select("n_nationkey", "name_key", F.substring("name_key", 1, GRAM).alias("gram")), "gram")
    around = rest.select("s_suppkey", "key", F.substring("key", 1, GRAM).alias("gram")).join(known.select("n_nationkey", "name_key", pieces(F.col("name_key"), [GRAM])), "gram")
    holds = F.col("key").contains(F.col("name_key")) | F.col("name_key").contains(F.col("key"))
    fuzzy = within.unionByName(around).where(holds).select("s_suppkey", F.lit(6).alias("rung"), "n_nationkey").distinct()
    best = best_row(early.unionByName(fuzzy), ["s_suppkey"], [F.col("rung"), F.col("n_nationkey")])
    state = F.when(F.col("rung") <= 3, "SWIFT").when(F.col("rung") == 4, "SWIFT_BASE8").when(F.col("rung") == 5, "NAME_EXACT").when(F.col("rung") == 6, "NAME_FUZZY").otherwise("UNRESOLVED")
    return x.select("s_suppkey").join(best, "s_suppkey", "left").select("s_suppkey", "n_nationkey", state.alias("state"))


def _country(s, d):
    """Countries as printed: a known two-letter code passes ("NA" is one, not a missing value), else aliases, else names without marks."""
    n = read(s, d, "nation").select("n_nationkey", c.text_key(F.col("n_name")).alias("key"), F.upper(F.substring("n_name", 1, 2)).alias("code2"), "n_name")
    codes = best_row(n, ["code2"], [F.col("n_nationkey")]).select("code2", F.col("n_nationkey").alias("by_code"))
    aliases = n.select(F.concat(F.lit("the"), F.col("key")).alias("key"), F.col("n_nationkey").alias("by_alias"))
    k = F.col("c_custkey") % 5
    x = read(s, d, "customer").join(F.broadcast(n.select(F.col("n_nationkey").alias("c_nationkey"), "n_name")), "c_nationkey")
    raw = F.when(k == 0, F.concat(F.lit(" "), F.lower(F.substring("n_name", 1, 2)))).when(k == 1, F.concat(F.lit("The "), F.initcap("n_name"))).when(k == 2, F.concat(F.lower("n_name"), F.lit("."))).when(k == 3, "NA")
    x = x.select("c_custkey", F.trim(raw).alias("raw")).withColumn("code2", F.when(F.char_length("raw") == 2, F.upper("raw"))).withColumn("key", c.text_key(F.col("raw")))
    x = x.join(F.broadcast(codes), "code2", "left").join(F.broadcast(aliases), "key", "left").join(F.broadcast(n.select("key", F.col("n_nationkey").alias("by_name"))), "key", "left")
    return x.select("c_custkey", F.coalesce("by_code", "by_alias", "by_name").alias("n_nationkey"))


def _duplicates(s, d):
    """Invoice numbers that two documents print, apart from spaces and case, with the documents."""
    x = read(s, d, "orders").select("o_orderkey", c.invoice_key(F.concat(F.lit("inv "), (F.col("o_custkey") % 97).cast("string"), F.lit("/ "), F.expr("cast(o_totalprice as bigint) % 10"))).alias("number"))
    g = x.groupBy("number").agg(F.count_distinct("o_orderkey").alias("n"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))
    return g.where("n > 1")


def _overlap(s, d):
    """Forms that name an invoice of their job: references and numbers share an element."""
    own = read(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set(F.col("l_partkey") % 40).alias("numbers"))
    x = read(s, d, "orders").select("o_orderkey", F.array(F.col("o_orderkey") % 40, F.col("o_custkey") % 40).alias("refs")).join(own, "o_orderkey")
    return x.where(F.arrays_overlap("refs", "numbers")).select("o_orderkey", F.size(F.array_intersect("refs", "numbers")).cast("long").alias("shared"), F.size(F.array_except("refs", "numbers")).cast("long").alias("unknown"))


_TOKS = "regexp_extract_all(lower({}), '[a-z0-9]+')"
QUERIES = {
    "hs_search_text": (_search_text, f"""WITH {_TARIFF}, q0 AS (SELECT DISTINCT p_name FROM part), q1 AS (SELECT p_name AS id, {_TOKS.format("substr(split_part(p_name, ' ', 1), 1, 3) || ' ' || substr(split_part(p_name, ' ', 2), 2, 9)")} AS t FROM q0), q AS (SELECT id, len(t) AS n, unnest(range(1, len(t) + 1)) AS i, unnest(t) AS q FROM q1),
w AS (SELECT DISTINCT code, unnest({_TOKS.format('description')}) AS w FROM tariff), b AS (SELECT id, n, i, code, max(CASE WHEN w = q THEN 10 WHEN starts_with(w, q) THEN 8 WHEN length(q) >= 4 AND contains(w, q) THEN 6 ELSE 0 END) AS level FROM q, w GROUP BY ALL),
r AS (SELECT id, code, CAST(round(sum(level)::DECIMAL(18,4) * 100 / any_value(n)) AS BIGINT) AS score FROM b GROUP BY 1, 2 HAVING min(level) > 0), p AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, code) AS place FROM r) SELECT id, code, score, place FROM p WHERE place <= 10"""),
    "hs_search_numeric": (_search_number, f"""WITH {_TARIFF}, q AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN code WHEN 1 THEN substr(code, 1, 8) ELSE substr(code, 1, 6) END AS digits FROM tariff),
p AS (SELECT q.p_partkey, t.code, CASE WHEN t.code = digits THEN 100 ELSE 90 END AS score FROM q JOIN tariff t ON starts_with(t.code, digits)), r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, code) AS place FROM p) SELECT * FROM r WHERE place <= 10"""),
    "hs_band_pick": (_band_pick, f"""WITH {_TARIFF}, m AS (SELECT p_partkey, code, substr(code, 1, 4) AS band, p_partkey % 7 = 0 AS other, description, p_brand FROM tariff JOIN part USING (p_partkey)),
t AS (SELECT *, list_filter({_TOKS.format("CASE WHEN other THEN 'Other' ELSE description END")}, lambda x: length(x) >= 2 AND NOT regexp_full_match(x, '[0-9]+')) AS d, list_filter({_TOKS.format('p_brand')}, lambda x: length(x) >= 2 AND NOT regexp_full_match(x, '[0-9]+')) AS e FROM m),
a AS (SELECT p_partkey, band, list_filter({_TOKS.format('description')}, lambda x: length(x) >= 2 AND NOT regexp_full_match(x, '[0-9]+')) AS q FROM m),
j AS (SELECT a.p_partkey, t.code, t.other, greatest(1, len(q)) AS n, list_sum(list_transform(q, lambda q: CASE WHEN len(list_filter(d, lambda b: q = b OR (length(q) >= 4 AND starts_with(b, q)) OR (length(b) >= 4 AND starts_with(q, b)))) > 0 THEN 2 WHEN len(list_filter(e, lambda b: q = b OR (length(q) >= 4 AND starts_with(b, q)) OR (length(b) >= 4 AND starts_with(q, b)))) > 0 THEN 1 ELSE 0 END)) AS points FROM a JOIN t USING (band)),
h AS (SELECT *, points * 50 >= n * 34 AS hit, max(CASE WHEN points * 50 >= n * 34 THEN 1 ELSE 0 END) OVER (PARTITION BY p_partkey) AS any_hit FROM j),
r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY hit DESC, CASE WHEN hit THEN -points END, CASE WHEN hit THEN other ELSE NOT other END, CASE WHEN hit THEN code END, code DESC) AS k FROM h) SELECT p_partkey, code, points::BIGINT AS half_points, NOT hit AS fallback FROM r WHERE k = 1"""),
    "bank_resolve_priority": (_bank, """WITH n AS (SELECT n_nationkey, n_name, upper(substr(md5(n_name), 1, 8)) AS b FROM nation), kn AS (SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN b || 'XXX' WHEN 1 THEN b || 'KTM' ELSE b END AS stored, regexp_replace(lower(n_name || ' bank'), '[^a-z0-9]+', '', 'g') AS nk FROM n),
x AS (SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN b WHEN 1 THEN b || 'ABC' WHEN 2 THEN 'NOSUCHXX' END AS base, regexp_replace(lower(CASE s_suppkey % 6 WHEN 3 THEN n_name || ' Bank.' WHEN 4 THEN n_name || ' bank limited' WHEN 5 THEN 'xyz' END), '[^a-z0-9]+', '', 'g') AS key FROM supplier JOIN n ON s_nationkey = n_nationkey),
c AS (SELECT s_suppkey, n_nationkey, CASE WHEN base = stored THEN 1 WHEN substr(base, 1, 8) = stored THEN 2 WHEN substr(base, 1, 8) || 'XXX' = stored THEN 3 WHEN substr(base, 1, 8) = substr(stored, 1, 8) THEN 4 WHEN key = nk THEN 5 WHEN length(key) > 5 AND (contains(key, nk) OR contains(nk, key)) THEN 6 END AS rung FROM x, kn),
r AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY rung, n_nationkey) AS k FROM c WHERE rung IS NOT NULL)
SELECT x.s_suppkey, n_nationkey, CASE WHEN rung <= 3 THEN 'SWIFT' WHEN rung = 4 THEN 'SWIFT_BASE8' WHEN rung = 5 THEN 'NAME_EXACT' WHEN rung = 6 THEN 'NAME_FUZZY' ELSE 'UNRESOLVED' END AS state FROM x LEFT JOIN r ON r.s_suppkey = x.s_suppkey AND k = 1"""),
    "country_normalize": (_country, """WITH n AS (SELECT *, regexp_replace(lower(n_name), '[^a-z0-9]+', '', 'g') AS nk, upper(substr(n_name, 1, 2)) AS c2 FROM nation), c2 AS (SELECT c2, min(n_nationkey) AS by_code FROM n GROUP BY 1),
x AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN lower(substr(n_name, 1, 2)) WHEN 1 THEN 'The ' || n_name WHEN 2 THEN n_name || '.' WHEN 3 THEN 'NA' END AS raw FROM customer JOIN nation ON c_nationkey = n_nationkey), y AS (SELECT *, regexp_replace(lower(coalesce(raw, '')), '[^a-z0-9]+', '', 'g') AS key FROM x)
SELECT c_custkey, coalesce(by_code, a.n_nationkey, b.n_nationkey) AS n_nationkey FROM y LEFT JOIN c2 ON length(raw) = 2 AND upper(raw) = c2 LEFT JOIN n a ON y.key = 'the' || a.nk LEFT JOIN n b ON y.key = b.nk"""),
    "invoice_number_duplicates": (_duplicates, "SELECT 'INV' || (o_custkey % 97) || '/' || (CAST(floor(o_totalprice) AS BIGINT) % 10) AS number, count(*) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last FROM orders GROUP BY 1 HAVING count(*) > 1"),
    "form_reference_overlap": (_overlap, """WITH o AS (SELECT l_orderkey, list(DISTINCT l_partkey % 40) AS numbers FROM lineitem GROUP BY 1), x AS (SELECT o_orderkey, list_distinct([o_orderkey % 40, o_custkey % 40]) AS refs, numbers FROM orders JOIN o ON o_orderkey = l_orderkey)
SELECT o_orderkey, len(list_intersect(refs, numbers)) AS shared, len(list_filter(refs, lambda r: NOT list_contains(numbers, r))) AS unknown FROM x WHERE list_has_any(refs, numbers)"""),
}
