"""Geo and reputation enrichment as joins against dimension tables
(P9, P10, J4-J7, J11, S10).

The reference calls HTTP services behind LRU caches; here each lookup is a
join or a scan:

* J4/J5 geo: **longest-prefix match by equi-joins**.  Addresses, IPv4 and IPv6, are
  128-bit numbers in two longs; networks and ranges of the dimension become
  blocks ``(prefix length, prefix)`` (a range has at most 62).  Each distinct address meets the
  blocks once for every prefix length that the dimension has, by plain
  equality; the narrowest range wins.  Private/reserved prefixes short-circuit before the join.
* J6/J7 reputation: **as-of merge scan**.  Events and records of an address
  run through one ordered scan in time buckets (``plans.scan``) that carries the last record
  forward; an event takes it while it is younger than the TTL.  One exchange, no pairs
  of events and records, no join back.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..plans.scan import BUCKET_COL, keyed_scan

#: The high bits of an IPv4 address written as IPv6 (``::ffff:a.b.c.d``).
MAPPED = 0xFFFF << 32

GEO_FIELDS = ["country", "country_code", "region", "city", "lat", "lon", "isp", "org", "asn",
              "is_proxy", "is_hosting", "is_private", "flag"]


# ---------------------------------------------------------------- P9 / P10
def ip_scope(ip: Column, prefixes: list[tuple[str, str]] | None = None) -> Column:
    """Label of the first matching private/reserved text prefix, else null (public)."""
    out = None
    for prefix, label in (prefixes or config.PRIVATE_PREFIXES):
        cond = ip.startswith(prefix)
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(F.lit(None).cast("string"))


def is_reputation_private(ip: Column) -> Column:
    """P10: the reputation service's private predicate (no link-local entry)."""
    cond = F.lit(False)
    for prefix in config.REPUTATION_PRIVATE:
        cond = cond | ip.startswith(prefix)
    return cond


def ipv4_to_long(ip: Column) -> Column:
    """Dotted IPv4 text -> 0..2^32-1; null for anything else (IPv6, junk)."""
    parts = F.split(ip, r"\.")
    valid = ip.rlike(r"^[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}$")
    num = F.lit(0).cast("long")
    for i in range(4):
        num = num * 256 + F.element_at(parts, i + 1).cast("long")
    return F.when(valid, num)


def ip_number(ip: Column) -> Column:
    """``STRUCT<hi, lo>``: the 128 bits of an IPv4 or IPv6 address (text) as two signed longs; null for anything else.

    IPv4 is its mapped IPv6 address.  Knows ``::``, upper and lower case, a dotted
    tail and a zone (``%eth0``, ignored).
    """
    v4 = ipv4_to_long(ip)
    plain = F.lower(F.regexp_replace(ip, "%.*$", ""))
    tail = r"^(.*:)([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})$"
    part = [F.regexp_extract(plain, tail, k).try_cast("int") for k in range(2, 6)]
    dotted = F.concat(F.regexp_extract(plain, tail, 1), F.lower(F.hex(part[0] * 256 + part[1])), F.lit(":"), F.lower(F.hex(part[2] * 256 + part[3])))
    halves = F.split(F.when(plain.rlike(tail), dotted).otherwise(plain), "::", -1)

    def words(h: Column, k: int) -> Column:
        return F.filter(F.split(F.coalesce(F.get(h, F.lit(k)), F.lit("")), ":"), lambda x: x != "")

    def groups(h: Column) -> Column:
        missing = F.lit(8) - F.size(words(h, 0)) - F.size(words(h, 1))
        whole = (F.array_join(words(h, 0), ":") == F.get(h, F.lit(0))) & (F.array_join(words(h, 1), ":") == F.get(h, F.lit(1)))
        return F.when((F.size(h) == 2) & (missing > 0) & whole, F.concat(words(h, 0), F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), words(h, 1))).when(
            F.size(h) == 1, F.split(F.get(h, F.lit(0)), ":"))

    def number(g: Column) -> Column:
        num = [F.conv(F.get(g, F.lit(k)), 16, 10).cast("long") for k in range(8)]
        hi, lo = (F.shiftleft(num[k], 48).bitwiseOR(F.shiftleft(num[k + 1], 32)).bitwiseOR(F.shiftleft(num[k + 2], 16)).bitwiseOR(num[k + 3]) for k in (0, 4))
        return F.when((F.size(g) == 8) & F.forall(g, lambda x: x.rlike("^[0-9a-f]{1,4}$")), F.struct(hi.alias("hi"), lo.alias("lo")))

    # each step is bound to a variable, so that it is evaluated once
    v6 = F.get(F.transform(F.transform(F.array(halves), groups), number), F.lit(0))
    return F.when(v4.isNotNull(), F.struct(F.lit(0).cast("long").alias("hi"), (F.lit(MAPPED) + v4).alias("lo"))).when(ip.contains(":"), v6)


def _prefix(hi: Column, lo: Column, length: Column) -> tuple[Column, Column]:
    """The first ``length`` (0 to 128) bits of a number, the others zero."""
    zero, ones = F.lit(0).cast("long"), F.lit(-1).cast("long")

    def mask(bits: Column) -> Column:
        return F.when(bits <= 0, zero).when(bits >= 64, ones).otherwise(F.call_function("shiftleft", ones, (F.lit(64) - bits).cast("int")))

    return hi.bitwiseAND(mask(length)), lo.bitwiseAND(mask(length - 64))


def geo_blocks(geo_dim: DataFrame) -> DataFrame:
    """``geo_dim`` as prefix blocks: its columns with ``_len, _hi, _lo`` and ``_width, _at`` (size and start of the whole row, for ties).

    A row is a CIDR ``network`` (text, IPv4 or IPv6) or, where that is null or absent, the IPv4 numbers
    ``start_ip`` to ``end_ip``, cut into aligned blocks.  Rows that are neither, or whose range is empty, match nothing.
    """
    cols = geo_dim.columns
    names = [c for c in cols if c not in ("network", "start_ip", "end_ip")]
    parts = []
    if "network" in cols:
        bits = F.split("network", "/").getItem(1).try_cast("int")
        net = geo_dim.where("network is not null").select(*names, ip_number(F.split("network", "/").getItem(0)).alias("_n"), F.when(F.col("network").contains(":"), bits).otherwise(bits + 96).alias("_len"))
        net = net.where("_n is not null and _len between 0 and 128")
        hi, lo = _prefix(F.col("_n.hi"), F.col("_n.lo"), F.col("_len"))
        parts.append(net.select(*names, "_len", hi.alias("_hi"), lo.alias("_lo"), F.pow(F.lit(2.0), F.lit(128) - F.col("_len")).alias("_width"), F.struct(hi, lo).alias("_at")))
    if "start_ip" in cols:
        ranges = geo_dim.where("network is null") if "network" in cols else geo_dim
        # from both ends inwards: a block of 2^l wherever an end is not a multiple of 2^(l+1)
        cut = """aggregate(sequence(0, 32), named_struct('s', start_ip, 'e', end_ip + 1, 'b', cast(array() as array<struct<at: bigint, l: int>>)),
            (x, l) -> if(x.s >= x.e, x, named_struct(
                's', x.s + if(shiftright(x.s, l) & 1 = 1, shiftleft(1L, l), 0L),
                'e', x.e - if(shiftright(x.e, l) & 1 = 1, shiftleft(1L, l), 0L),
                'b', concat(x.b,
                    if(shiftright(x.s, l) & 1 = 1, array(named_struct('at', x.s, 'l', l)), cast(array() as array<struct<at: bigint, l: int>>)),
                    if(shiftright(x.e, l) & 1 = 1 and x.e - shiftleft(1L, l) >= x.s + if(shiftright(x.s, l) & 1 = 1, shiftleft(1L, l), 0L),
                        array(named_struct('at', x.e - shiftleft(1L, l), 'l', l)), cast(array() as array<struct<at: bigint, l: int>>))))), x -> x.b)"""
        zero = F.lit(0).cast("long")
        parts.append(ranges.where("start_ip between 0 and end_ip and end_ip < 4294967296").select(*names, "start_ip", "end_ip", F.explode(F.expr(cut)).alias("_b")).select(
            *names, (F.lit(128) - F.col("_b.l")).alias("_len"), zero.alias("_hi"), (F.lit(MAPPED) + F.col("_b.at")).alias("_lo"),
            (F.col("end_ip") - F.col("start_ip") + 1).cast("double").alias("_width"), F.struct(zero, F.lit(MAPPED) + F.col("start_ip")).alias("_at")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---------------------------------------------------------------- J4 / J5
def _unknown_geo() -> list[Column]:
    return [F.lit("Unknown").alias("country"), F.lit("XX").alias("country_code"), F.lit("").alias("region"),
            F.lit("").alias("city"), F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"), F.lit("").alias("isp"),
            F.lit("").alias("org"), F.lit("").alias("asn"), F.lit(False).alias("is_proxy"),
            F.lit(False).alias("is_hosting"), F.lit(False).alias("is_private"), F.lit("").alias("flag")]


def geo_lookup(ips: DataFrame, geo_dim: DataFrame, ip_col: str = "ip", enabled: bool = True) -> DataFrame:
    """One geo record per row of ``ips`` (``ip_col`` + the geo fields).

    Empty / ``?`` / disabled -> unknown record; private prefix -> private
    record (country = scope label, isp ``Local Network``); a dimension network or range (see ``geo_blocks``)
    that holds the address -> that record, the narrowest and then the lowest if several do; otherwise unknown.
    """
    ip = F.col(ip_col)
    scope = ip_scope(ip)
    d = ips.select("*", scope.alias("_scope"), ip_number(ip).alias("_ipn"))
    unknown = F.struct(*_unknown_geo())
    if not enabled:
        return d.select(*ips.columns, unknown.alias("_g")).select(*ips.columns, "_g.*")
    public = d.filter(ip.isNotNull() & (ip != "") & (ip != "?") & F.col("_scope").isNull()
                      & F.col("_ipn").isNotNull()).select("_ipn").distinct()
    rec_cols = [c for c in GEO_FIELDS if c not in ("is_private", "flag")]
    dim = geo_blocks(geo_dim.select(*[c for c in geo_dim.columns if c in ("network", "start_ip", "end_ip", *rec_cols)]))
    lengths = sorted(r[0] for r in dim.select("_len").distinct().collect())     # prefix lengths: at most 129
    probe = public.withColumn("_len", F.explode(F.array(*[F.lit(x) for x in lengths]).cast("array<int>")))
    hi, lo = _prefix(F.col("_ipn.hi"), F.col("_ipn.lo"), F.col("_len"))
    m = probe.withColumn("_hi", hi).withColumn("_lo", lo).join(dim, ["_len", "_hi", "_lo"])
    # overlapping ranges: the narrowest, then the lowest start, wins
    best = m.groupBy("_ipn").agg(F.min_by(F.struct(*rec_cols), F.struct("_width", "_at")).alias("_rec"))
    j = d.join(best, "_ipn", "left")
    rec = F.col("_rec")
    private = F.struct(F.col("_scope").alias("country"), F.lit("XX").alias("country_code"), F.lit("").alias("region"),
                       F.lit("").alias("city"), F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"),
                       F.lit("Local Network").alias("isp"), F.lit("").alias("org"), F.lit("").alias("asn"),
                       F.lit(False).alias("is_proxy"), F.lit(False).alias("is_hosting"),
                       F.lit(True).alias("is_private"), F.lit("").alias("flag"))
    found = F.struct(*[rec.getField(c).alias(c) for c in rec_cols], F.lit(False).alias("is_private"),
                     F.concat(F.lit("https://flagcdn.com/16x12/"), F.lower(rec.getField("country_code")),
                              F.lit(".png")).alias("flag"))
    g = (F.when(ip.isNull() | (ip == "") | (ip == "?"), unknown)
         .when(F.col("_scope").isNotNull(), private)
         .when(rec.isNotNull(), found)
         .otherwise(unknown))
    return j.select(*ips.columns, g.alias("_g")).select(*ips.columns, "_g.*")


def enrich_geo(df: DataFrame, geo_dim: DataFrame, ip_col: str = "src_ip", prefix: str = "geo_") -> DataFrame:
    """Enrich each distinct address once, then join the records back.

    A null address has the empty one's record, so the join is plain equality (a skewed one that adaptive execution splits).
    """
    ips = df.select(F.coalesce(F.col(ip_col), F.lit("")).alias("_ip")).distinct()
    g = geo_lookup(ips, geo_dim, "_ip")
    g = g.select("_ip", *[F.col(c).alias(prefix + c) for c in GEO_FIELDS])
    return df.withColumn("_of", F.coalesce(F.col(ip_col), F.lit(""))).join(g, F.col("_of") == F.col("_ip"), "left").drop("_ip", "_of")


# ---------------------------------------------------------------- J6 / J7
REP_FIELDS = ["abuse_score", "is_known_bad", "total_reports", "country", "isp", "domain", "source"]


def enrich_reputation(events: DataFrame, rep_dim: DataFrame, ip_col: str = "src_ip", ts_col: str = "ts_us",
                      ttl_s: int = config.REPUTATION_TTL_S, known_bad: int = config.KNOWN_BAD_SCORE, prefix: str = "rep_",
                      bucket_s: float = 300) -> DataFrame:
    """J6 + J7: as-of reputation per event with a TTL.

    ``rep_dim``: ``rep_id ip fetched_at_us abuse_score total_reports country
    isp domain exposure`` (exposure = ``STRUCT<ports, os, org, hostnames,
    source>``).  Empty/``?`` -> ``unknown``; private (P10) -> ``private``
    with an empty exposure; no valid record -> ``default``, not scanned.

    Of records fetched at one time the largest ``rep_id`` counts as the newest; a record fetched at the event's
    time is seen by it.  Any bucket width gives the same answer.  An event without a time sees no record.
    """
    ttl = int(ttl_s * 1_000_000)
    found = ["abuse_score", "total_reports", "country", "isp", "domain", "exposure"]
    rec = F.struct("fetched_at_us", *found)
    # at one time records come first, in the order of their ids
    ev = events.select(F.struct(*[F.col(f"`{c}`") for c in events.columns]).alias("_e"), F.coalesce(F.col(ip_col), F.lit("")).alias("_k"),
                       F.col(ts_col).alias("_ts"), F.struct(F.lit(1).alias("kind"), F.lit(0).cast("long").alias("id")).alias("_tie"))
    dim = rep_dim.where("ip is not null and fetched_at_us is not null").select(
        F.col("ip").alias("_k"), F.col("fetched_at_us").alias("_ts"), F.struct(F.lit(0).alias("kind"), F.col("rep_id").cast("long").alias("id")).alias("_tie"), rec.alias("_r"))
    both = keyed_scan(ev.unionByName(dim, allowMissingColumns=True), ["_k"], "_ts", "_tie", int(bucket_s * 1_000_000), lasts=[("_last", F.col("_r"))])
    j = both.where("_tie.kind = 1").select("_e.*", F.when(F.col("_ts") - F.col("_last.fetched_at_us") < ttl, F.col("_last")).alias("_rec"))
    ip = F.col(ip_col)
    rec = F.col("_rec")
    private = is_reputation_private(ip)
    empty_ip = ip.isNull() | (ip == "") | (ip == "?")
    score = F.when(rec.isNotNull(), rec.getField("abuse_score")).otherwise(F.lit(0))
    src = (F.when(empty_ip, F.lit("unknown")).when(private, F.lit("private"))
           .when(rec.isNotNull(), F.lit("abuseipdb")).otherwise(F.lit("default")))
    exp = rec.getField("exposure")
    empty_exp = F.struct(F.array().cast("array<int>").alias("ports"), F.lit("Unknown OS").alias("os"),
                         F.lit("Unknown Org").alias("org"), F.array().cast("array<string>").alias("hostnames"),
                         F.when(empty_ip, F.lit("empty")).when(private, F.lit("private")).otherwise(F.lit("not_scanned")).alias("source"))
    use = rec.isNotNull() & ~private & ~empty_ip
    cols = {
        "abuse_score": F.when(use, score).otherwise(F.lit(0)).cast("int"),
        "is_known_bad": F.when(use, score > known_bad).otherwise(F.lit(False)),
        "total_reports": F.when(use, rec.getField("total_reports")).otherwise(F.lit(0)).cast("int"),
        "country": F.when(use, rec.getField("country")).otherwise(F.lit("XX")),
        "isp": F.when(use, rec.getField("isp")).otherwise(F.lit("")),
        "domain": F.when(use, rec.getField("domain")).otherwise(F.lit("")),
        "source": src,
        "exposure": F.when(use, exp).otherwise(empty_exp),
    }
    return j.select(*events.columns, *[c.alias(prefix + n) for n, c in cols.items()])
