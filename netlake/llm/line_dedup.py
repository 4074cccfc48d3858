"""Line dedup by winnowing over line hashes, in DataFrame functions only.

Units are lines that hold a word (white space, ``\\x20 \\x09-\\x0d``, around them trimmed and between words).  A gram is
the hash of the lines from one on until they hold ``gram_words`` words.  A window
is the grams that start within ``run_words - gram_words`` words; its
smallest gram is a fingerprint.  Any run of lines with ``run_words`` words or more
holds a whole window, and the window's choice depends on the run alone: two
copies of a run always share a fingerprint.

Each fingerprint joins to its first place in the corpus (smallest id, then
line).  The match is extended both ways along its diagonal while the
lines are equal, and the lines of the later copy go.

That first place may be an older text which shares just the gram, so runs are also
keyed by themselves: from each line on the fewest lines that hold ``run_words`` words, and
up to each line the fewest that do.  Every line of a run of ``run_words`` words or
more lies in such a run within it, so where every key's first place stays and the lines of its
later places go, the lines of every run that occurred before go.  A run
can only recur if its fingerprint does: only runs that hold a fingerprint found twice are keyed.

The first place of a line never goes: every deleted line equals an earlier one.

Scale.  Texts are read to hash their lines and to rewrite them; in between only hashes
move.  A fingerprint's first place is a pre-aggregated minimum, its join back a skewed
equi-join; each later copy is compared with one earlier place, never all pairs.
Run keys likewise: a minimum for each key, joined back.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.stage import materialize, release

GRAM_WORDS, RUN_WORDS = 20, 50
_SPACE = r"[\x20\x09-\x0D]"


def _line_hash(x):
    return F.conv(F.substring(F.md5(x), 1, 15), 16, 10).cast("long")


def _runs(arrays: DataFrame, found: DataFrame, run_words: int) -> DataFrame:
    """``(id, ver, p, n, k1, k2)``: the least runs of ``run_words`` words from and up to each line, where they hold a place in ``found``.

    A run up to a line that is also the least from its first line on is listed once.
    """
    at = found.groupBy("id", "ver").agg(F.array_sort(F.collect_set("p")).alias("at"))
    flags = """flatten(transform(at, (x, j) -> concat(array_repeat(0, x - if(j = 0, -1, at[greatest(j - 1, 0)]) - 1), array(1))))"""
    line = arrays.join(at, ["id", "ver"]).withColumn("m", F.expr(flags)).select("id", "ver", F.posexplode(F.arrays_zip("h", "w", "m")).alias("p", "z"))
    line = line.select("id", "ver", "p", "z.h", "z.w", "z.m")
    doc = Window.partitionBy("id", "ver")
    line = line.withColumn("e", F.sum("w").over(doc.orderBy("p"))).withColumn("c", F.col("e") - F.col("w")).withColumn("total", F.sum("w").over(doc))
    on, upto = doc.orderBy("c").rangeBetween(0, run_words - 1), doc.orderBy("e").rangeBetween(1 - run_words, 0)
    for x, w in (("on", on), ("upto", upto)):
        line = line.withColumn(x, F.struct(F.collect_list("h").over(w).alias("h"), F.max("m").over(w).alias("m"), F.min("c").over(w).alias("c")))
    line = line.select("id", "ver", F.explode(F.array(
        F.when((F.col("total") - F.col("c") >= run_words) & (F.col("on.m") == 1), F.struct("p", F.col("on.h").alias("h"))),
        F.when((F.col("e") >= run_words) & (F.col("upto.m") == 1) & (F.col("c") - F.col("upto.c") >= run_words), F.struct((F.col("p") - F.size("upto.h") + 1).alias("p"), F.col("upto.h").alias("h"))))).alias("r")).where("r is not null")
    return line.select("id", "ver", "r.p", F.size("r.h").alias("n"), F.xxhash64("r.h").alias("k1"), F.xxhash64(F.lit(1), "r.h").alias("k2"))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram_words: int = GRAM_WORDS, run_words: int = RUN_WORDS) -> DataFrame:
    """``(id, ver, gone)``: for each text with later copies of a run, the numbers (from 0) of the lines that go.

    ``ver`` is ``xxhash64`` of the text: rows that repeat an id and its text are one document.
    """
    raw = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("ver"), F.split(F.col(text_col).cast("string"), "\n").alias("lines")).where("id is not null and lines is not null")
    kept = F.filter(F.transform("lines", lambda x, i: F.struct(i.alias("i"), F.regexp_replace(x, f"\\A{_SPACE}+|{_SPACE}+\\z", "").alias("t"))), lambda s: s["t"] != "")
    arrays = raw.select("id", "ver", kept.alias("k")).select(
        "id", "ver", F.transform("k", lambda s: s["i"]).alias("i"), F.transform("k", lambda s: _line_hash(s["t"])).alias("h"),
        F.transform("k", lambda s: F.size(F.split(s["t"], f"{_SPACE}+"))).alias("w")).where("size(i) > 0")
    arrays = materialize(arrays.dropDuplicates(["id", "ver"]), "lines")
    line = arrays.select("id", "ver", F.posexplode(F.arrays_zip("h", "w")).alias("p", "z")).select("id", "ver", "p", "z.h", "z.w")
    doc = Window.partitionBy("id", "ver")
    line = line.withColumn("c", F.sum("w").over(doc.orderBy("p")) - F.col("w")).withColumn("left", F.sum("w").over(doc) - F.col("c")).where(f"left >= {gram_words}")
    by_words = doc.orderBy("c")
    line = line.withColumn("gram", F.md5(F.concat_ws(",", F.collect_list(F.col("h").cast("string")).over(by_words.rangeBetween(0, gram_words - 1)))))
    line = line.withColumn("least", F.min(F.struct("gram", "p")).over(by_words.rangeBetween(0, run_words - gram_words))).where(f"left >= {run_words}")
    marks = materialize(line.select("id", "ver", "least.gram", "least.p").distinct(), "marks")
    # first places are cut from their aggregation: a join of two plain shuffles is one whose hot keys can be split
    first = materialize(marks.groupBy("gram").agg(F.min(F.struct("id", "p", "ver")).alias("f"), F.count("*").alias("n")).where("n > 1").select("gram", "f"), "first")
    found = materialize(marks.join(first, "gram").select("id", "ver", "p", "f"), "found")
    release(marks, first)
    runs = materialize(_runs(arrays, found, run_words), "runs")
    before = materialize(runs.groupBy("k1", "k2").agg(F.min(F.struct("id", "p", "ver")).alias("f"), F.count("*").alias("c")).where("c > 1").select("k1", "k2", "f"), "before")
    later = materialize(runs.join(before, ["k1", "k2"]).where("struct(id, p, ver) > f").select("id", "ver", "p", "n"), "later")
    again = later.groupBy("id", "ver").agg(F.collect_set(F.struct("p", "n")).alias("at"))
    again = again.join(arrays.select("id", "ver", "i"), ["id", "ver"]).select("id", "ver", F.expr("array_distinct(flatten(transform(at, r -> slice(i, r.p + 1, r.n))))").alias("gone"))
    hits = found.where("struct(id, p, ver) > f").select("id", "ver", "p", F.col("f.id").alias("id0"), F.col("f.ver").alias("ver0"), (F.col("f.p") - F.col("p")).alias("step"))
    lanes = hits.groupBy("id", "ver", "id0", "ver0", "step").agg(F.collect_set("p").alias("at"))
    lanes = lanes.join(arrays.select("id", "ver", "i", "h"), ["id", "ver"]).join(arrays.select(F.col("id").alias("id0"), F.col("ver").alias("ver0"), F.col("h").alias("h0")), ["id0", "ver0"])
    lanes = lanes.withColumn("lo", F.expr("greatest(0, -step)")).withColumn("hi", F.expr("least(size(h), size(h0) - step) - 1"))
    lanes = lanes.withColumn("same", F.expr("array_join(transform(sequence(lo, hi), p -> if(h[p] = h0[p + step], '1', '0')), '')")).withColumn("back", F.expr("reverse(same)"))
    run = """array_distinct(transform(at, p -> struct(
        lo + if(locate('0', back, length(same) - p + lo) = 0, 0, length(same) - locate('0', back, length(same) - p + lo) + 1) as a,
        lo + if(locate('0', same, p - lo + 1) = 0, length(same), locate('0', same, p - lo + 1) - 1) as b)))"""
    spans = lanes.select("id", "ver", F.expr(f"flatten(transform({run}, r -> slice(i, r.a + 1, r.b - r.a)))").alias("gone"))
    gone = materialize(spans.unionAll(again).groupBy("id", "ver").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("gone")), "gone")
    release(arrays, found, runs, before, later)
    return gone


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram_words: int = GRAM_WORDS, run_words: int = RUN_WORDS) -> DataFrame:
    """All rows and columns of ``docs`` with later repeated runs cut from the text, plus ``lines_removed`` (array of line numbers).

    Null texts and null ids stay as they are; an empty text stays empty; a text whose
    lines all repeat becomes empty; blank lines stay.  Repeated rows of one id and text are
    one document and both change alike.  Ties between equal fingerprints go to the
    smaller id, then the earlier line.  An input column ``lines_removed`` is replaced; no other name is reserved.

    Texts meet their line numbers in one hash join at every size, keyed by id and text.
    """
    free = "_" * (1 + max(map(len, docs.columns)))  # longer than any column: prefixed names are free
    key, ver, cut = free + "id", free + "ver", free + "cut"
    gone = repeated_lines(docs, id_col, text_col, gram_words, run_words).select(F.col("id").alias(key), F.col("ver").alias(ver + "0"), F.col("gone").alias(cut))
    rows = docs.drop("lines_removed").withColumn(ver, F.xxhash64(text_col))
    out = rows.join(gone.hint("shuffle_hash"), (F.col(f"`{id_col}`") == F.col(key)) & (F.col(ver) == F.col(ver + "0")), "left")
    lines = F.split(F.col(f"`{text_col}`"), "\n")
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(cut)), lambda i: F.get(lines, i))
    return out.select(*[F.when(F.col(cut).isNull(), F.col(f"`{c}`")).otherwise(F.array_join(left, "\n")).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns if c != "lines_removed"],
                      F.coalesce(F.col(cut), F.array().cast("array<int>")).alias("lines_removed"))


def oracle(gram_words: int = GRAM_WORDS, run_words: int = RUN_WORDS) -> str:
    """DuckDB: lines of any run of ``run_words`` words seen before, and the islands of equal lines around a fingerprint's first place.

    Runs are keyed by their whole list of line hashes, every run of every text, without
    the choice of runs by fingerprint; islands are found line by line instead of in arrays.
    """
    space = "[\\x20\\x09-\\x0D]"
    return f"""
with raw as (select doc_id as id, text, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as i from documents),
k as (select id, i, regexp_replace(line, '^{space}+|{space}+$', '', 'g') as t from raw where regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
l as (select id, i, t, ('0x' || substr(md5(t), 1, 15))::bigint as h, len(string_split_regex(t, '{space}+')) as w, row_number() over (partition by id order by i) - 1 as p from k),
c as (select *, (sum(w) over (partition by id order by p) - w)::bigint as c, (sum(w) over (partition by id order by p))::bigint as e, sum(w) over (partition by id) as total from l),
g as (select *, md5(array_to_string(list(h::varchar) over (partition by id order by c range between current row and {gram_words - 1} following), ',')) as gram from c where total - c >= {gram_words}),
m as (select *, min(gram || lpad(p::varchar, 9, '0')) over (partition by id order by c range between current row and {run_words - gram_words} following) as least from g),
marks as (select distinct id, substr(least, 1, 32) as gram, substr(least, 33)::bigint as p from m where total - c >= {run_words}),
f as (select gram, min(struct_pack(id := id, p := p)) as f from marks group by gram),
hits as (select marks.id, marks.p, f.f.id as id0, f.f.p - marks.p as step from marks join f using (gram) where struct_pack(id := marks.id, p := marks.p) > f.f),
lanes as (select distinct id, id0, step from hits),
eq as (select lanes.*, a.p, a.i from lanes join l a on a.id = lanes.id join l b on b.id = lanes.id0 and b.p = a.p + lanes.step and b.h = a.h),
isl as (select *, p - row_number() over (partition by id, id0, step order by p) as grp from eq),
good as (select distinct isl.id, isl.id0, isl.step, isl.grp from isl join hits using (id, id0, step, p)),
upto as (select id, p, e, list(h) over up as hs, min(p) over up as a from c window up as (partition by id order by e range between {run_words - 1} preceding and current row)),
onto as (select id, p, total - c as rest, list(h) over down as hs, max(p) over down as b from c window down as (partition by id order by c range between current row and {run_words - 1} following)),
runs as (select id, p as a, b, hs from onto where rest >= {run_words} union select id, a, p as b, hs from upto where e >= {run_words}),
seen as (select id, a, b, min(struct_pack(id := id, p := a)) over (partition by hs) as f from runs),
again as (select id, a, b from seen where struct_pack(id := id, p := a) > f),
gone as (select isl.id, isl.i from isl join good using (id, id0, step, grp) union select l.id, l.i from again join l on l.id = again.id and l.p between again.a and again.b),
left_ as (select raw.id, string_agg(line, chr(10) order by raw.i) as text from raw left join gone on gone.id = raw.id and gone.i = raw.i where gone.i is null group by raw.id),
n as (select id, count(*) as n, string_agg(i::varchar, ',' order by i) as removed from gone group by id)
select d.doc_id, coalesce(n.n, 0)::bigint as n_removed, coalesce(n.removed, '') as removed, case when d.text is null then null else md5(coalesce(left_.text, '')) end as kept_md5
from documents d left join n on n.id = d.doc_id left join left_ on left_.id = d.doc_id"""
