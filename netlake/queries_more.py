"""Registers the queries of phases 2 and later (imported lazily by catalog)."""
from __future__ import annotations

from pyspark.sql import functions as F

from . import fixtures as fx
from .catalog import flows, register
from .config import Thresholds
from .functions.stats import exact_percentile
from .operators import reports as rp
from .operators import verdict as vd
from .twins import verdict as tvd

# ------------------------------------------------------------------ phase 2: rules and verdicts


def verdicts_no_model(spark, sf_dir):
    return vd.classify(vd.no_model(flows(spark, sf_dir)))


def scored(spark, sf_dir, anomaly=False):
    return vd.ensemble_decision(fx.scored_flows(flows(spark, sf_dir)), th=Thresholds(anomaly_enabled=anomaly))


@register("rule_hits", tvd.RULE_HITS_SQL)
def q_rule_hits(spark, sf_dir):
    """First matching rule per flow (null when none)."""
    return flows(spark, sf_dir).select("flow_id", vd.rule_label().alias("rule_label"))


@register("verdicts_no_model", tvd.VERDICTS_NO_MODEL_SQL)
def q_verdicts_no_model(spark, sf_dir):
    """P16 + P17 + J1/J2: verdicts when no model is loaded."""
    return verdicts_no_model(spark, sf_dir).select(*vd.VERDICT_COLS)


@register("verdicts", tvd.VERDICTS_SQL)
def q_verdicts(spark, sf_dir):
    """P15-P19 + J1-J3: verdicts from fixture model scores, anomaly override off (the default)."""
    return vd.classify(scored(spark, sf_dir)).select(*vd.VERDICT_COLS)


@register("ensemble_decision", tvd.ENSEMBLE_SQL)
def q_ensemble_decision(spark, sf_dir):
    """Ensemble decision with the isolation-forest override on."""
    return scored(spark, sf_dir, anomaly=True).select("flow_id", "ml_label", "ml_label_id", "ml_confidence",
                                                      "ml_is_attack")


@register("ensemble_scores", tvd.ENSEMBLE_SCORES_SQL)
def q_ensemble_scores(spark, sf_dir):
    """P20: the score map, one row per (flow, score name)."""
    return scored(spark, sf_dir, anomaly=True).select("flow_id", F.explode("scores").alias("score_name", "score"))


@register("zero_day_override", tvd.ZERO_DAY_SQL)
def q_zero_day_override(spark, sf_dir):
    """A13 + F13 + P18: p95 error threshold, reconstruction score, zero-day override."""
    s = fx.scored_flows(flows(spark, sf_dir))
    thr = exact_percentile(s, "ae_error", 0.95)
    v = vd.classify(vd.ensemble_decision(s))
    return vd.zero_day_override(v, "ae_error", thr).select("flow_id", "ae_score", "is_zero_day", "label",
                                                           "severity", "is_attack")


@register("label_stats", tvd.LABEL_STATS_SQL)
def q_label_stats(spark, sf_dir):
    """A2: verdict counts per label, zero-filled, with the total."""
    return rp.label_stats(verdicts_no_model(spark, sf_dir))


@register("recent_events", tvd.RECENT_EVENTS_SQL)
def q_recent_events(spark, sf_dir):
    """O1: the latest 100 verdict events."""
    return rp.recent_events(verdicts_no_model(spark, sf_dir).select(*vd.VERDICT_COLS), 100)


# ------------------------------------------------------------------ phase 3: DNS
from .operators import dns as dn  # noqa: E402
from .twins import dns as tdn  # noqa: E402


def dns_verdicts(spark, sf_dir):
    return dn.dns_verdicts(fx.dns_queries(spark, sf_dir))


@register("dns_entropy", tdn.DNS_ENTROPY_SQL)
def q_dns_entropy(spark, sf_dir):
    """F1 + F2: domain label and Shannon entropy per query."""
    q = fx.dns_queries(spark, sf_dir).withColumn("qname", dn.clean_qname(F.col("qname")))
    return dn.entropy_table(q)


@register("dns_dga", tdn.DNS_DGA_SQL)
def q_dns_dga(spark, sf_dir):
    """generated-domain reason per query (null = looks normal)."""
    q = fx.dns_queries(spark, sf_dir).withColumn("qname", dn.clean_qname(F.col("qname")))
    return q.select("packet_id", dn.dga_reason(dn.domain_label(F.col("qname"))).alias("dga_reason"))


@register("dns_rate", tdn.DNS_RATE_SQL)
def q_dns_rate(spark, sf_dir):
    """Per-source query count in the trailing 60 s, capped at 1000."""
    return dn.dns_rate(fx.dns_queries(spark, sf_dir)).select("packet_id", "src_ip", "recent")


@register("dns_alerts", tdn.DNS_ALERTS_SQL)
def q_dns_alerts(spark, sf_dir):
    """F4 + D9: tunnelling / generated-domain / flood alerts."""
    return dn.dns_alerts(fx.dns_queries(spark, sf_dir))


@register("dns_stats", tdn.DNS_STATS_SQL)
def q_dns_stats(spark, sf_dir):
    """Total queries, attacks, tracked source addresses."""
    return dn.dns_stats(dns_verdicts(spark, sf_dir))


@register("dns_recent", tdn.DNS_RECENT_SQL)
def q_dns_recent(spark, sf_dir):
    """Latest 50 DNS alerts (buffer of 500)."""
    return rp.latest(dn.dns_alerts(fx.dns_queries(spark, sf_dir)), 50, "ts_us", "packet_id")


# ------------------------------------------------------------------ phase 4: behaviour
from .operators import behavior as bh  # noqa: E402
from .twins import behavior as tbh  # noqa: E402


def behavior_events(spark, sf_dir):
    v = vd.classify(scored(spark, sf_dir))
    return v.select("flow_id", "src_ip", "dst_port", "label", "total_length_fwd_packets",
                    F.col("last_seen_us").alias("ts_us"))


def profiles(spark, sf_dir):
    return bh.ip_profiles(behavior_events(spark, sf_dir))


@register("ip_running_score", tbh.RUNNING_SQL)
def q_ip_running_score(spark, sf_dir):
    """W5 + A7 + P21: threat score of the source after each event."""
    r = bh.running_scores(behavior_events(spark, sf_dir))
    return r.select("flow_id", "src_ip", "ts_us", "attack_count", "normal_count", "severe_count", "ports_count",
                    "recent_events", "threat_score", "risk_level")


@register("ip_profiles", tbh.PROFILES_SQL)
def q_ip_profiles(spark, sf_dir):
    """A6 + A7 + W10 + P21: final profile per source address."""
    return profiles(spark, sf_dir)


@register("ip_label_counts", tbh.LABEL_COUNTS_SQL)
def q_ip_label_counts(spark, sf_dir):
    """A6 labels map, flattened: events per (source, label)."""
    return bh.label_counts(behavior_events(spark, sf_dir))


RUNNING_COLS = ["flow_id", "src_ip", "ts_us", "attack_count", "normal_count", "severe_count", "ports_count", "recent_events", "threat_score", "risk_level"]


@register("ip_running_score_idle", tbh.RUNNING_IDLE_SQL)
def q_ip_running_score_idle(spark, sf_dir):
    """W5 where sources pause for hours: a profile idle for more than an hour starts anew."""
    return bh.running_scores(fx.idle_events(spark, sf_dir)).select(*RUNNING_COLS)


@register("ip_profiles_idle", tbh.PROFILES_IDLE_SQL)
def q_ip_profiles_idle(spark, sf_dir):
    """A6 where sources pause for hours: the profile of each source's latest life."""
    return bh.ip_profiles(fx.idle_events(spark, sf_dir))


@register("top_threats", tbh.TOP_THREATS_SQL)
def q_top_threats(spark, sf_dir):
    """O2: the 15 highest threat scores."""
    return bh.top_threats(profiles(spark, sf_dir), 15)


@register("risk_breakdown", tbh.RISK_SQL)
def q_risk_breakdown(spark, sf_dir):
    """Profiles per risk level with the total."""
    return bh.risk_breakdown(profiles(spark, sf_dir))


@register("active_profiles", tbh.ACTIVE_SQL)
def q_active_profiles(spark, sf_dir):
    """Profiles seen within the hour before the latest event, at most 1000."""
    p = profiles(spark, sf_dir)
    return bh.active_profiles(p, F.col("as_of_us"))


@register("profile_lookup", tbh.PROFILE_LOOKUP_SQL)
def q_profile_lookup(spark, sf_dir):
    """O3: one profile by address."""
    return bh.profile_of(profiles(spark, sf_dir), "203.0.113.5")


# ------------------------------------------------------------------ phase 5: enrichment
from .operators import enrich as en  # noqa: E402
from .twins import enrich as ten  # noqa: E402


@register("ip_scope", ten.IP_SCOPE_SQL)
def q_ip_scope(spark, sf_dir):
    """private/reserved scope of every address seen."""
    p = fx.packets(spark, sf_dir)
    ips = p.select(F.col("src_ip").alias("ip")).union(p.select(F.col("dst_ip").alias("ip"))).distinct()
    return ips.select("ip", en.ip_scope(F.col("ip")).alias("scope"))


@register("geo_enriched", ten.GEO_ENRICHED_SQL)
def q_geo_enriched(spark, sf_dir):
    """J4 + J5: geo record per packet source (distinct addresses enriched once)."""
    p = fx.packets(spark, sf_dir).select("packet_id", "src_ip")
    return en.enrich_geo(p, fx.geo_dim(spark, sf_dir), "src_ip")


@register("geo_prefix_match", ten.GEO_PREFIX_SQL)
def q_geo_prefix_match(spark, sf_dir):
    """J4 on both address families: longest-prefix match over nested networks and ranges."""
    g = en.enrich_geo(fx.address_book(spark, sf_dir), fx.network_dim(spark, sf_dir), "ip")
    return g.select("c_custkey", F.col("geo_country").alias("country"), F.col("geo_is_private").alias("is_private"))


def _rep(spark, sf_dir, ttl_s):
    p = fx.packets(spark, sf_dir).select("packet_id", "src_ip", "ts_us")
    return en.enrich_reputation(p, fx.reputation_dim(spark, sf_dir), ttl_s=ttl_s)


@register("reputation_asof", ten.REPUTATION_SQL)
def q_reputation_asof(spark, sf_dir):
    """J6 + P10: as-of reputation per packet source, TTL 300 s."""
    r = _rep(spark, sf_dir, 300)
    return r.select("packet_id", "src_ip", "rep_abuse_score", "rep_is_known_bad", "rep_total_reports",
                    "rep_country", "rep_isp", "rep_domain", "rep_source")


@register("host_exposure", ten.EXPOSURE_SQL)
def q_host_exposure(spark, sf_dir):
    """Host exposure sub-record (ports and hostnames as text)."""
    r = _rep(spark, sf_dir, 300)
    e = F.col("rep_exposure")
    return r.select("packet_id", F.array_join(e.getField("ports").cast("array<string>"), ",").alias("exp_ports"),
                    e.getField("os").alias("exp_os"), e.getField("org").alias("exp_org"),
                    F.array_join(e.getField("hostnames"), ",").alias("exp_hostnames"),
                    e.getField("source").alias("exp_source"))


def detection_events(spark, sf_dir):
    """Verdict + running profile + geo + reputation for every flow."""
    v = vd.classify(scored(spark, sf_dir))
    ev = v.select("flow_id", "src_ip", "dst_port", "label", "total_length_fwd_packets",
                  F.col("last_seen_us").alias("ts_us"))
    run = bh.running_scores(ev).select("flow_id", "threat_score", "risk_level")
    d = v.join(run, "flow_id", "left")
    d = en.enrich_geo(d, fx.geo_dim(spark, sf_dir), "src_ip")
    return en.enrich_reputation(d, fx.reputation_dim(spark, sf_dir), "src_ip", "last_seen_us")


@register("detection_events", ten.DETECTION_SQL)
def q_detection_events(spark, sf_dir):
    """J11 + S10 (flattened): the assembled detection event."""
    d = detection_events(spark, sf_dir)
    return d.select("flow_id", "src_ip", "dst_ip", "dst_port", "label", "severity", "confidence", "is_attack",
                    F.coalesce("threat_score", F.lit(0.0)).alias("threat_score"),
                    F.coalesce("risk_level", F.lit("LOW")).alias("risk_level"),
                    "geo_country", "geo_is_private", "rep_abuse_score", "rep_is_known_bad", "rep_source")


# ------------------------------------------------------------------ phase 6: response and reports
from .operators import response as rs  # noqa: E402
from .plans.stage import materialize  # noqa: E402
from .sources import sinks as sk  # noqa: E402
from .twins import response as trs  # noqa: E402


def _throttled(alerts):
    return rs.throttle(alerts.withColumn("source_rank", F.lit(0)), tie="alert_id")


BLOCK_S = 60


def block_states(spark, sf_dir, verdicts):
    """Strikes of the attack verdicts, and all verdicts with their block state."""
    verdicts = materialize(verdicts, "verdicts")
    st = rs.strikes_and_blocks(verdicts.filter("is_attack"), duration_s=BLOCK_S, ts="last_seen_us", tie="flow_id")
    st = materialize(st.select("flow_id", "src_ip", F.col("last_seen_us"), "status", "strike_no", "until_us"), "verdict-strikes")
    return rs.block_state(verdicts, st.withColumnRenamed("last_seen_us", "ts_us"))


@register("event_block_state", trs.EVENT_BLOCK_STATE_SQL)
def q_event_block_state(spark, sf_dir):
    """J10 + J11: strike and block state of every verdict's source at its time."""
    d = block_states(spark, sf_dir, vd.classify(scored(spark, sf_dir)))
    return d.select("flow_id", "src_ip", F.col("last_seen_us").alias("ts_us"), "is_attack", "block_status", "strike_no", "auto_blocked", "source_blocked")


@register("alerts_throttled", trs.THROTTLE_GAPPY_SQL)
def q_alerts_throttled(spark, sf_dir):
    """Greedy 30 s cooldown per label on the gappy alert stream."""
    t = rs.throttle(fx.alert_events(spark, sf_dir, "gappy"))
    return t.filter("emitted").select("alert_id", "label", "ts_us")


@register("alerts_throttled_dense", trs.THROTTLE_DENSE_SQL)
def q_alerts_throttled_dense(spark, sf_dir):
    """W7 on a stream with no quiet gaps: one chain per label."""
    t = rs.throttle(fx.alert_events(spark, sf_dir, "dense"))
    return t.filter("emitted").select("alert_id", "label", "ts_us")


def alerts_union(spark, sf_dir):
    v = vd.classify(scored(spark, sf_dir))
    d = dn.dns_alerts(fx.dns_queries(spark, sf_dir))
    h = rp.with_service(fx.honeypot_hits(spark, sf_dir))
    return rs.union_alerts(v, d, h)


@register("alerts_union", trs.ALERTS_UNION_SQL)
def q_alerts_union(spark, sf_dir):
    """Flow attacks + DNS alerts + honeypot hits as one alert stream."""
    return alerts_union(spark, sf_dir).select(*rs.ALERT_COLS)


@register("alerts_union_throttled", trs.ALERTS_UNION_THROTTLED_SQL)
def q_alerts_union_throttled(spark, sf_dir):
    """U3 + W7: the alerts that pass the per-label cooldown."""
    u = alerts_union(spark, sf_dir)
    rank = F.create_map(*[x for k, v in rs.SOURCE_RANK.items() for x in (F.lit(k), F.lit(v))])[F.col("source")]
    # arrival order at equal time: flow, dns, honeypot, then id -> one sortable tie key
    u = u.withColumn("_tie", rank.cast("long") * F.lit(10 ** 15) + F.col("alert_id"))
    t = rs.throttle(u, tie="_tie")
    return t.filter("emitted").select("source", "alert_id", "label", "ts_us")


def strikes(spark, sf_dir):
    return rs.strikes_and_blocks(fx.strike_events(spark, sf_dir), duration_s=60)


@register("strikes", trs.STRIKES_SQL)
def q_strikes(spark, sf_dir):
    """W8 + J9 + J10: strike / block / ignored status per attack event (60 s blocks)."""
    return strikes(spark, sf_dir).select("event_id", "src_ip", "ts_us", "label", "status", "strike_no")


@register("blocks", trs.BLOCKS_SQL)
def q_blocks(spark, sf_dir):
    """Block intervals."""
    return rs.blocks(strikes(spark, sf_dir))


def strikes_now(spark, sf_dir):
    """Strikes, written once, and the one-row time of the last of them (null without any)."""
    st = materialize(strikes(spark, sf_dir), "strikes")
    return st, st.agg(F.max("ts_us").alias("now_us"))


@register("blocked_now", trs.BLOCKED_NOW_SQL)
def q_blocked_now(spark, sf_dir):
    """Blocks active at the last attack time, with remaining seconds."""
    st, now = strikes_now(spark, sf_dir)
    return rs.blocked_at(rs.blocks(st).crossJoin(F.broadcast(now)), F.col("now_us"), duration_s=BLOCK_S)     # one row


@register("honeypot_by_service", trs.HONEYPOT_BY_SERVICE_SQL)
def q_honeypot_by_service(spark, sf_dir):
    """J8 + A4: honeypot hits per service with the total."""
    return rp.honeypot_by_service(fx.honeypot_hits(spark, sf_dir))


@register("honeypot_top_ips", trs.HONEYPOT_TOP_SQL)
def q_honeypot_top_ips(spark, sf_dir):
    """A5: top-10 honeypot sources."""
    return rp.honeypot_top_ips(fx.honeypot_hits(spark, sf_dir), 10)


@register("honeypot_recent", trs.HONEYPOT_RECENT_SQL)
def q_honeypot_recent(spark, sf_dir):
    """Latest 50 honeypot hits."""
    return rp.recent_hits(fx.honeypot_hits(spark, sf_dir), 50)


@register("latest_packets", trs.LATEST_PACKETS_SQL)
def q_latest_packets(spark, sf_dir):
    """The last 5000 packets of the capture buffer."""
    return rp.latest_packets(fx.packets(spark, sf_dir), 5000)


@register("throughput", trs.THROUGHPUT_SQL)
def q_throughput(spark, sf_dir):
    """KB/s per 2 s window and direction for local prefix 10."""
    return rp.throughput(fx.packets(spark, sf_dir), ["10."], 2)


@register("posture", trs.POSTURE_SQL)
def q_posture(spark, sf_dir):
    """Sensor posture score, rating and advice."""
    p = rp.posture(fx.sensor_status(spark, sf_dir))
    return p.withColumn("recommendations", F.array_join("recommendations", "|"))


@register("dashboard_stats", trs.DASHBOARD_SQL)
def q_dashboard_stats(spark, sf_dir):
    """One-row dashboard totals."""
    v = vd.classify(scored(spark, sf_dir))
    st, now = strikes_now(spark, sf_dir)
    return rp.dashboard_stats(v, rs.blocks(st), fx.honeypot_hits(spark, sf_dir), dns_verdicts(spark, sf_dir), profiles(spark, sf_dir), fx.packets(spark, sf_dir), now)


# ------------------------------------------------------------------ phase 7: labelled flow tables
from .functions.columns import round_bin  # noqa: E402
from .operators import dataset as ds  # noqa: E402
from .sources.flow_csv import read_flow_csv  # noqa: E402
from .twins import dataset as tds  # noqa: E402


def raw_csv(spark, sf_dir):
    return read_flow_csv(spark, fx.flow_csv_paths(spark, sf_dir))


def cleaned(spark, sf_dir):
    from .plans.stage import materialize
    return materialize(ds.clean_flows(raw_csv(spark, sf_dir)), "flows-cleaned")


@register("csv_cleaned", tds.CSV_CLEANED_SQL)
def q_csv_cleaned(spark, sf_dir):
    """S1 + U1 + P4-P8: two CSV files read, unioned, normalised and cleaned."""
    return cleaned(spark, sf_dir)


@register("clean_stats", tds.CLEAN_STATS_SQL)
def q_clean_stats(spark, sf_dir):
    """Rows before/after cleaning and unmapped labels."""
    return ds.clean_stats(raw_csv(spark, sf_dir))


@register("label_distribution", tds.LABEL_DIST_SQL)
def q_label_distribution(spark, sf_dir):
    """A3: label counts and percentages."""
    return ds.label_distribution(cleaned(spark, sf_dir))


def split(spark, sf_dir):
    """The split's rows are written once, cleaned and hashed; readers take from them the columns they need."""
    return ds.stratified_split(ds.clean_flows(raw_csv(spark, sf_dir)))


@register("stratified_split", tds.SPLIT_SQL)
def q_stratified_split(spark, sf_dir):
    """M2: stratified 80/20 split by row hash."""
    return split(spark, sf_dir).select("h1", "h2", "label", "is_test")


@register("class_weights", tds.CLASS_WEIGHTS_SQL)
def q_class_weights(spark, sf_dir):
    """A10: balanced class weights on the training split."""
    return ds.class_weights(split(spark, sf_dir).filter(~F.col("is_test")))


@register("scaler_moments", tds.SCALER_SQL)
def q_scaler_moments(spark, sf_dir):
    """M3: standard-scaler moments (population std) fitted on the training split."""
    m = ds.scaler_moments(split(spark, sf_dir).filter(~F.col("is_test")))
    return m.select("feature", round_bin(F.col("mean"), 6).alias("mean"), round_bin(F.col("std"), 6).alias("std"))


# ------------------------------------------------------------------ phase 8: models and metrics
from .ml import autoenc as mae  # noqa: E402
from .ml import boosting as mbo  # noqa: E402
from .ml import hoeffding as mho  # noqa: E402
from .ml import iforest as mif  # noqa: E402
from .ml import metrics as mm  # noqa: E402
from .ml import models as mdl  # noqa: E402
from .ml import online as mon  # noqa: E402
from .ml import trees as mtr  # noqa: E402
from .twins import ml as tml  # noqa: E402


def fixture_predictions(spark, sf_dir):
    s = split(spark, sf_dir).filter(F.col("is_test"))
    return s.select("h1", "h2", "label",
                    F.when(F.col("h1") % 10 != 0, F.col("label")).otherwise((F.col("label") + 1) % 5).alias("prediction"),
                    (F.col("h2") % 7 == 0).alias("flagged"))


@register("classification_report", tml.CLASS_REPORT_SQL)
def q_classification_report(spark, sf_dir):
    """Per-class precision / recall / F1 / support (fixture predictions)."""
    return mm.classification_report(fixture_predictions(spark, sf_dir))


@register("classification_summary", tml.CLASS_SUMMARY_SQL)
def q_classification_summary(spark, sf_dir):
    """Accuracy, weighted and macro F1."""
    p = fixture_predictions(spark, sf_dir)
    s = mm.classification_summary(mm.classification_report(p), p)
    return s.select("accuracy", round_bin(F.col("f1_weighted"), 10).alias("f1_weighted"),
                    round_bin(F.col("f1_macro"), 10).alias("f1_macro"))


@register("detector_rates", tml.DETECTOR_SQL)
def q_detector_rates(spark, sf_dir):
    """Detection rate and false-positive rate of a binary detector."""
    return mm.detector_rates(fixture_predictions(spark, sf_dir))


@register("running_accuracy", tml.RUNNING_ACC_SQL)
def q_running_accuracy(spark, sf_dir):
    """Cumulative accuracy over the prediction stream."""
    r = mm.running_accuracy(fixture_predictions(spark, sf_dir), "h1", "h2", bucket=1 << 22)
    return r.select("h1", "h2", "running_accuracy")


def _scaled_split(spark, sf_dir):
    sp = split(spark, sf_dir)
    tr, te = sp.filter(~F.col("is_test")), sp.filter(F.col("is_test"))
    mo = [(r["feature"], float(r["mean"]), float(r["std"])) for r in ds.scaler_moments(tr).collect()]
    return ds.standardize(tr, mo), ds.standardize(te, mo), tr


@register("rf_scores")
def q_rf_scores(spark, sf_dir):
    """M4 + M8: weighted random forest (500 x depth 20) scored on the held-out split."""
    tr, te, _ = _scaled_split(spark, sf_dir)
    m = mtr.train_classifier(tr)
    p = mtr.predict(m, te)
    return p.select("h1", "h2", "label", F.col("prediction").cast("int").alias("prediction"),
                    F.array_max("probability").alias("confidence"))


@register("feature_importance")
def q_feature_importance(spark, sf_dir):
    """Top-20 feature importances of the forest."""
    tr, _, _ = _scaled_split(spark, sf_dir)
    return mtr.feature_importance(mtr.train_classifier(tr), top=20)


@register("iforest_scores")
def q_iforest_scores(spark, sf_dir):
    """M6: isolation forest on benign training rows; score and -1/1 flag on the held-out split."""
    tr, te, _ = _scaled_split(spark, sf_dir)
    benign = tr.filter(F.col("label") == 0)
    nodes, psi = mif.fit_iforest(benign, mdl.config.FEATURE_NAMES)
    cut = exact_percentile(mif.score_iforest(spark, benign, nodes, psi, mdl.config.FEATURE_NAMES), "iso_score", 0.05)
    s = mif.score_iforest(spark, te, nodes, psi, mdl.config.FEATURE_NAMES)
    return s.select("h1", "h2", "label", "iso_score",
                    F.when(F.col("iso_score") < F.lit(cut), -1).otherwise(1).alias("iso_flag"))


@register("ae_scores")
def q_ae_scores(spark, sf_dir):
    """M7 + A13 + F13: reconstruction error, score and zero-day flag on the held-out split."""
    sp = split(spark, sf_dir)
    m = mae.fit_autoencoder(sp.filter(~F.col("is_test") & (F.col("label") == 0)), k=32)
    e = mae.reconstruction_error(sp.filter(F.col("is_test")), m)
    return e.select("h1", "h2", "label", "ae_error",
                    vd.reconstruction_score(F.col("ae_error"), F.lit(m.threshold)).alias("ae_score"),
                    (F.col("ae_error") > m.threshold).alias("is_zero_day"))


@register("cv_metrics")
def q_cv_metrics(spark, sf_dir):
    """M5: 5-fold stratified CV accuracy / weighted F1 (200 x depth 8 forests), mean and deviation over the folds."""
    return mtr.cross_validate(ds.stratified_folds(split(spark, sf_dir), 5))


@register("boosted_round")
def q_boosted_round(spark, sf_dir):
    """M4: the nodes of one full boosting round (a tree of depth 10 per class) over the training split."""
    tr, _, _ = _scaled_split(spark, sf_dir)
    m = mtr.train_boosted_classifier(tr, params=mbo.BoostParams(rounds=1))
    rows = [(m.classes[t.label], i, m.features[f] if f >= 0 else None, float(c) if f >= 0 else None, float(g), float(v))
            for t in m.trees for i, (f, c, g, v) in enumerate(zip(t.feature, t.cut, t.gain, t.value))]
    return spark.createDataFrame(rows, "label int, node int, feature string, threshold double, gain double, value double")


@register("split_gains", tml.SPLIT_GAINS_SQL)
def q_split_gains(spark, sf_dir):
    """M9: information gain of each feature's best cut in a leaf that has learnt the whole table."""
    leaf = mho.HoeffdingTree(grace=1 << 62)
    leaf.learn(cleaned(spark, sf_dir))
    state = spark.createDataFrame([s for s in leaf.state if s[2] != mho.COUNTERS], mho.STATE)
    names = F.array(*[F.lit(f) for f in leaf.features])
    return mho.feature_gains(state, leaf.cuts).select(
        F.element_at(names, F.col("feature") + 1).alias("feature"), round_bin(F.col("c.gain"), 6).alias("gain"))


@register("online_tree_accuracy")
def q_online_tree_accuracy(spark, sf_dir):
    """M9 + T10 + A14: the incremental tree tested, then trained on each batch of a stream of 8 files."""
    from .plans.stage import materialize
    rows = cleaned(spark, sf_dir)
    each = max(-(-rows.rdd.getNumPartitions() // 8), 1)     # 8 batches of as many files as the table needs
    c = materialize(rows.repartition(8 * each), "online-stream")
    files = c.inputFiles()
    stream = spark.readStream.schema(c.schema).option("maxFilesPerTrigger", each).parquet(files[0].rsplit("/", 1)[0])
    return mho.learn_stream(stream, srun._base(spark, "online"))


@register("online_accuracy")
def q_online_accuracy(spark, sf_dir):
    """M9 + T10 + A14: prequential accuracy of the online model over 8 hash-ordered batches."""
    from .plans.stage import materialize
    c = materialize(cleaned(spark, sf_dir).withColumn(
        "_b", F.pmod(ds.row_hash(mdl.config.FEATURE_NAMES + ["label"], 7), F.lit(8))), "online-batches", by="_b")
    model = mon.OnlineNB()
    res = mon.prequential(model, [c.filter(F.col("_b") == i) for i in range(8)])
    return spark.createDataFrame(res or [(0, 0, 0)], "batch int, correct long, scored long")


@register("model_metadata")
def q_model_metadata(spark, sf_dir):
    """M10 + S8: train every model, save and reload, return the metadata record."""
    models, _ = mdl.train(cleaned(spark, sf_dir))
    path = mdl.save(models, spark=spark)
    back = mdl.load(spark, path)
    meta = dict(back.metadata)
    meta.pop("trained_at", None)
    return mdl.metadata_frame(spark, meta)


# ------------------------------------------------------------------ phase 9: streaming
from .streaming import dns_rate as sdns  # noqa: E402
from .streaming import flows as sfl  # noqa: E402
from .streaming import runner as srun  # noqa: E402
from .streaming import state_ops as sst  # noqa: E402
from .twins import behavior as tbh2  # noqa: E402
from .twins import flows as tfl2  # noqa: E402

FAR_US = 10 ** 12          # the end marker sits this far after the last event
MARKER_IP = "0.0.0.250"


def _staged(df, tag, n_files=4, marker=None):
    hi = df.agg(F.max("ts_us")).first()[0]
    m = dict(marker or {})
    m.setdefault("ts_us", int(hi) + FAR_US)
    path = srun.stage_files(df, "ts_us", n_files, tag, end_marker=m)
    return srun.read_stream(df.sparkSession, path, df.schema)


@register("stream_flows", tfl2.FLOW_FEATURES_SQL)
def q_stream_flows(spark, sf_dir):
    """T2 + T9: stateful streaming flow assembly (4 micro-batches) == batch flow_features."""
    p = fx.packets(spark, sf_dir)
    s = _staged(p, "packets", marker={"packet_id": -1, "src_ip": MARKER_IP, "dst_ip": MARKER_IP, "src_port": 0,
                                      "dst_port": 0, "protocol": 0, "length": 0, "header_length": 0,
                                      "window_size": -1, "tcp_flags": 0, "ip_version": 4})
    return srun.run_to_table(sfl.stream_flows(s), "flows")


@register("stream_throttle", trs.THROTTLE_GAPPY_SQL)
def q_stream_throttle(spark, sf_dir):
    """T4: streaming greedy cooldown == batch alerts_throttled."""
    a = fx.alert_events(spark, sf_dir, "gappy")
    s = _staged(a, "alerts", marker={"alert_id": -1, "label": "__end__", "src_ip": MARKER_IP})
    out = srun.run_to_table(sst.stream_throttle(s), "throttle")
    return out.filter(F.col("label") != "__end__").select("alert_id", "label", "ts_us")


@register("stream_strikes", trs.STRIKES_SQL)
def q_stream_strikes(spark, sf_dir):
    """T5: streaming strikes / blocks with expiry == batch strikes."""
    a = fx.strike_events(spark, sf_dir)
    s = _staged(a, "strikes", marker={"event_id": -1, "src_ip": MARKER_IP, "label": "__end__"})
    out = srun.run_to_table(sst.stream_strikes(s, duration_s=60), "strikes")
    return out.filter(F.col("src_ip") != MARKER_IP).select("event_id", "src_ip", "ts_us", "label", "status",
                                                           "strike_no")


@register("stream_profiles", tbh2.RUNNING_SQL)
def q_stream_profiles(spark, sf_dir):
    """Streaming per-source profiles (1 h TTL) == batch ip_running_score."""
    from .plans.stage import materialize
    ev = materialize(behavior_events(spark, sf_dir), "profile-events")
    s = _staged(ev, "profiles", marker={"flow_id": -1, "src_ip": MARKER_IP, "dst_port": 0, "label": "Normal",
                                        "total_length_fwd_packets": 0})
    out = srun.run_to_table(sst.stream_profiles(s), "profiles")
    return out.filter(F.col("src_ip") != MARKER_IP).select(
        "flow_id", "src_ip", "ts_us", "attack_count", "normal_count", "severe_count", "ports_count",
        "recent_events", "threat_score", "risk_level")


@register("stream_profiles_idle", tbh2.RUNNING_IDLE_SQL)
def q_stream_profiles_idle(spark, sf_dir):
    """T6 where sources pause for hours == batch ip_running_score_idle."""
    s = _staged(fx.idle_events(spark, sf_dir), "profiles-idle", marker={"flow_id": -1, "src_ip": MARKER_IP, "dst_port": 0, "label": "Normal", "total_length_fwd_packets": 0})
    out = srun.run_to_table(sst.stream_profiles(s), "profiles-idle")
    return out.filter(F.col("src_ip") != MARKER_IP).select(*RUNNING_COLS)


STREAM_DNS_WINDOWS_SQL = f"""WITH q AS ({fx.DNS_QUERIES_SQL}),
w AS (SELECT src_ip, (ts_us // 10000000) * 10000000 - k * 10000000 AS window_start_us, ts_us
      FROM q, (SELECT unnest(range(0, 6)) AS k) ks)
SELECT window_start_us, src_ip, count(*) AS queries FROM w
WHERE ts_us >= window_start_us AND ts_us < window_start_us + 60000000 GROUP BY window_start_us, src_ip"""


@register("stream_dns_windows", STREAM_DNS_WINDOWS_SQL)
def q_stream_dns_windows(spark, sf_dir):
    """Per-source DNS queries in 60 s windows sliding by 10 s (watermarked, append)."""
    q = fx.dns_queries(spark, sf_dir)
    s = _staged(q, "dns", marker={"packet_id": -1, "src_ip": MARKER_IP, "qname": "end.marker"})
    out = srun.run_to_table(sst.stream_rate_windows(s), "dnswin")
    return out.filter(F.col("src_ip") != MARKER_IP)


STREAM_LABEL_COUNTS_SQL = ("SELECT label, count(*) AS events FROM (" + fx.alert_events_sql("gappy") + ") t "
                           "GROUP BY label")


@register("stream_dns_alerts", tdn.DNS_ALERTS_SQL)
def q_stream_dns_alerts(spark, sf_dir):
    """The exact rate and verdict of every query on a stream == batch dns_alerts."""
    q = fx.dns_queries(spark, sf_dir)
    s = _staged(q, "dns-exact", marker={"packet_id": -1, "src_ip": MARKER_IP, "qname": "end.of.input"})
    out = srun.run_to_table(sdns.stream_dns_verdicts(s), "dns-exact", conf=sdns.STATE_STORE)
    return dn.alert_rows(out.filter(F.col("src_ip") != MARKER_IP))


LATE_SQL = f"""WITH q AS (SELECT *, packet_id % 50 = 0 AS held FROM ({fx.DNS_QUERIES_SQL}) t WHERE qname IS NOT NULL),
b AS (SELECT min(ts_us) + 3 * ((max(ts_us) - min(ts_us)) // 4 + 1) AS cut FROM q WHERE NOT held),
m AS (SELECT (max(ts_us) // 1000 - 120000) * 1000 AS mark FROM q, b WHERE NOT held AND ts_us < cut)
SELECT count(*) AS queries, count(*) FILTER (WHERE held AND ts_us <= mark) AS late_rows, count(*) FILTER (WHERE NOT (held AND ts_us <= mark)) AS judged FROM q, m"""


@register("stream_late_rows", LATE_SQL)
def q_stream_late_rows(spark, sf_dir):
    """Every 50th query arrives after all others; those behind the watermark are dropped by the state operator and counted.

    Spark judges a batch's rows by the watermark that the batch before ran with: here that of the first three of four files."""
    q = fx.dns_queries(spark, sf_dir).filter("qname is not null")
    path = srun.stage_files(q.filter("packet_id % 50 <> 0"), "ts_us", 4, "dns-late")
    srun.add_file(q.filter("packet_id % 50 = 0"), path)
    out = srun.run_to_table(sdns.stream_dns_verdicts(srun.read_stream(spark, path, q.schema)), "dns-late", conf=sdns.STATE_STORE)
    late, rows = srun.LAST_RUN["late_rows_dropped"], srun.LAST_RUN["input_rows"]
    return out.agg(F.lit(rows).cast("long").alias("queries"), F.lit(late).cast("long").alias("late_rows"), F.count(F.lit(1)).alias("judged"))


@register("stream_label_counts", STREAM_LABEL_COUNTS_SQL)
def q_stream_label_counts(spark, sf_dir):
    """Running label counts in complete mode; the last batch is the final table."""
    a = fx.alert_events(spark, sf_dir, "gappy")
    s = _staged(a, "labels", marker=None)
    out = srun.run_to_table(sst.stream_label_counts(s), "labels", output_mode="complete")
    last = out.agg(F.max("batch_id")).first()[0]
    return out.filter((F.col("batch_id") == last) & (F.col("label").isNotNull())).select("label", "events")


@register("stream_throughput", trs.THROUGHPUT_SQL)
def q_stream_throughput(spark, sf_dir):
    """Tumbling 2 s throughput on the packet stream == batch throughput."""
    p = fx.packets(spark, sf_dir)
    s = _staged(p, "tput", marker={"packet_id": -1, "src_ip": MARKER_IP, "dst_ip": MARKER_IP, "src_port": 0,
                                   "dst_port": 0, "protocol": 0, "length": 0, "header_length": 0,
                                   "window_size": -1, "tcp_flags": 0, "ip_version": 4})
    out = srun.run_to_table(sst.stream_throughput(s, ["10."]), "tput")
    return out.filter(F.col("direction") != "other")


# ------------------------------------------------------------------ X3: SQL functions
from .functions.sql import register_sql_functions  # noqa: E402

SQL_FUNCTIONS_SQL = ("WITH " + tdn.dns_cte() + "\nSELECT packet_id, dga_reason, " + ten.scope_sql("src_ip")
                     + " AS scope FROM dns")


@register("sql_functions", SQL_FUNCTIONS_SQL)
def q_sql_functions(spark, sf_dir):
    """The SQL-callable functions used from SQL text over the DNS queries."""
    register_sql_functions(spark)
    fx.dns_queries(spark, sf_dir).createOrReplaceTempView("nl_dns_queries")
    return spark.sql("SELECT packet_id, dga_reason(domain_label(TRIM(TRAILING '.' FROM qname))) AS dga_reason, "
                     "ip_scope(src_ip) AS scope FROM nl_dns_queries")


SQL_SCORE_SQL = tbh.RUNNING_SQL.replace("\nSELECT * FROM running",
                                        "\nSELECT flow_id, threat_score, risk_level FROM running")


@register("sql_threat_score", SQL_SCORE_SQL)
def q_sql_threat_score(spark, sf_dir):
    """threat_score / risk_level SQL functions over the running profile counts."""
    register_sql_functions(spark)
    bh.running_scores(behavior_events(spark, sf_dir)).createOrReplaceTempView("nl_running")
    return spark.sql("SELECT flow_id, threat_score(attack_count, normal_count, ports_count, recent_events, "
                     "severe_count) AS threat_score, risk_level(threat_score(attack_count, normal_count, ports_count, "
                     "recent_events, severe_count)) AS risk_level FROM nl_running")


# ------------------------------------------------------------------ sinks: S5 / S6 / S10 / P23
@register("export_rows", ten.EXPORT_SQL)
def q_export_rows(spark, sf_dir):
    """S6 pre-write frame: the log records without scores, nested cells as JSON text."""
    return sk.export_rows(sk.log_records(detection_events(spark, sf_dir)))


@register("event_log_roundtrip", ten.EVENT_LOG_SQL)
def q_event_log_roundtrip(spark, sf_dir):
    """S5 + S6: the log as JSON lines and as CSV export, each read back and listed whole."""
    import uuid

    from .session import checkpoint_dir
    base = f"{checkpoint_dir(spark).rstrip('/')}/netlake/eventlog-{uuid.uuid4().hex}"
    rec = materialize(sk.log_records(detection_events(spark, sf_dir)), "log")
    sk.write_events(rec, base + "/jsonl", max_records_per_file=500)
    sk.export_csv(rec, base + "/csv")
    flat = sk.export_rows(rec)
    js = sk.export_rows(spark.read.schema(rec.schema).json(base + "/jsonl"))
    cs = spark.read.schema(flat.schema).option("header", True).option("escape", '"').option("enforceSchema", False).csv(base + "/csv")
    return js.withColumn("medium", F.lit("jsonl")).unionByName(cs.withColumn("medium", F.lit("csv")).fillna("", ["recommendation"]))


def detection_payload(d):
    """The nested detection event (geo / threat / behavior structs)."""
    ae = F.col("ae_score") if "ae_score" in d.columns else F.lit(0.0)
    return d.select(
        "flow_id", F.date_format(F.timestamp_micros("last_seen_us"), "HH:mm:ss").alias("timestamp"), "src_ip", "dst_ip",
        "dst_port", "label", "severity", "severity_icon", "confidence", "is_attack", "auto_blocked", "recommendation", "scores", ae.alias("ae_score"),
        F.struct(*[F.col(f"geo_{c}").alias(c) for c in ("country", "country_code", "city", "lat", "lon", "flag",
                                                        "is_proxy")]).alias("geo"),
        F.struct(F.col("rep_abuse_score").alias("abuse_score"), F.col("rep_is_known_bad").alias("is_known_bad"),
                 F.col("rep_total_reports").alias("total_reports"), F.col("rep_exposure").alias("shodan")).alias("threat"),
        F.struct(F.coalesce("threat_score", F.lit(0.0)).alias("threat_score"),
                 F.coalesce("risk_level", F.lit("LOW")).alias("risk_level")).alias("behavior"))


@register("detection_payload", trs.DETECTION_PAYLOAD_SQL)
def q_detection_payload(spark, sf_dir):
    """Detection event payload with block state, nested parts as JSON text."""
    d = detection_payload(block_states(spark, sf_dir, detection_events(spark, sf_dir)))
    return d.drop("scores").select(*[F.to_json(c).alias(c) if c in ("geo", "threat", "behavior") else c for c in d.columns if c != "scores"])


@register("alert_text", trs.ALERT_TEXT_SQL)
def q_alert_text(spark, sf_dir):
    """P23 + S9: dispatch text of the throttled flow, DNS and honeypot alerts, handed to a table writer."""
    import uuid

    from .session import checkpoint_dir
    u = materialize(alerts_union(spark, sf_dir), "alerts")
    rank = F.create_map(*[x for k, v in rs.SOURCE_RANK.items() for x in (F.lit(k), F.lit(v))])[F.col("source")]
    sent = rs.throttle(u.withColumn("_tie", rank.cast("long") * F.lit(10 ** 15) + F.col("alert_id")), tie="_tie").filter("emitted").drop("_tie", "emitted")
    sent = en.enrich_geo(sent, fx.geo_dim(spark, sf_dir), "src_ip")
    sent = en.enrich_reputation(sent, fx.reputation_dim(spark, sf_dir))
    st = rs.strikes_and_blocks(u.filter("source = 'flow'").select("alert_id", "src_ip", "ts_us"), duration_s=BLOCK_S, tie="alert_id")
    hit = st.filter("status = 'blocked'").select(F.col("alert_id").alias("_id"), F.lit(True).alias("_hit"))
    sent = sent.join(hit, (F.col("source") == "flow") & (F.col("alert_id") == F.col("_id")), "left").withColumn("auto_blocked", F.coalesce("_hit", F.lit(False)))
    msg = rs.format_alerts(sent, auto_block_enabled=True).select("source", "alert_id", "label", "severity_mark", "open_ports", "mitigation", "message")
    out = f"{checkpoint_dir(spark).rstrip('/')}/netlake/alerts-{uuid.uuid4().hex}"
    rs.dispatch_alerts(msg, sk.table_writer(out))
    return spark.read.parquet(out).drop("batch_id")


# ------------------------------------------------------------------ S3 / S4: capture files
from .sources import capture as cap  # noqa: E402

# a TCP header always carries a window; a table row's "no window" (-1) goes on the wire as 0
CAPTURE_SQL = ("SELECT ts_us, src_ip, dst_ip, src_port, dst_port, protocol, length, header_length, "
               "CASE WHEN protocol = 6 THEN greatest(window_size, 0) ELSE window_size END AS window_size, "
               "tcp_flags, ip_version FROM (" + fx.PACKETS_SQL + ") t")


@register("capture_roundtrip", CAPTURE_SQL)
def q_capture_roundtrip(spark, sf_dir):
    """S3 + S4: packets written as capture files (one per partition) and decoded back.

    The wire has no "no window" value for TCP: -1 is written as 0."""
    import uuid

    from .session import checkpoint_dir
    path = f"{checkpoint_dir(spark).rstrip('/')}/netlake/pcap-{uuid.uuid4().hex}"
    cap.write_captures(fx.packets(spark, sf_dir), path)
    return cap.read_packets(spark, path)


@register("capture_stream", CAPTURE_SQL)
def q_capture_stream(spark, sf_dir):
    """The same capture files read as a stream."""
    import uuid

    from .session import checkpoint_dir
    path = f"{checkpoint_dir(spark).rstrip('/')}/netlake/pcap-{uuid.uuid4().hex}"
    cap.write_captures(fx.packets(spark, sf_dir), path, rows_per_file=5_000)
    return srun.run_to_table(cap.read_packets(spark, path, streaming=True, files_per_trigger=8), "capture")


def ethernet_frames(packets):
    """Ethernet frames of IPv4 packets, put together byte by byte in SQL (not by the encoder)."""
    def num(e, digits):
        return F.lpad(F.hex(e), digits, "0")

    def addr(c):
        return F.array_join(F.transform(F.split(c, r"\."), lambda x: num(x.cast("int"), 2)), "")

    total = F.greatest("length", "header_length")
    ip = F.concat(F.lit("4500"), num(total, 4), F.lit("0000000040"), num(F.col("protocol"), 2), F.lit("0000"), addr("src_ip"), addr("dst_ip"))
    ports = F.concat(num(F.col("src_port"), 4), num(F.col("dst_port"), 4))
    tcp = F.concat(ports, F.lit("0" * 16 + "50"), num(F.col("tcp_flags"), 2), num(F.greatest("window_size", F.lit(0)), 4), F.lit("00000000"))
    l4 = F.when(F.col("protocol") == 6, tcp).otherwise(F.concat(ports, F.lit("00080000")))
    body = F.concat(F.repeat(F.lit("00"), 12), F.lit("0800"), ip, l4)
    whole = F.expr("14 + greatest(length, header_length)")
    return packets.where("ip_version = 4 and protocol in (6, 17)").select("ts_us", F.unhex(F.rpad(body, whole * 2, "0")).alias("frame"))


ETHERNET_SQL = ("SELECT ts_us, src_ip, dst_ip, src_port, dst_port, protocol, CAST(14 + greatest(length, header_length) AS INTEGER) AS length, header_length, "
                "CASE WHEN protocol = 6 THEN greatest(window_size, 0) ELSE -1 END AS window_size, CASE WHEN protocol = 6 THEN tcp_flags ELSE 0 END AS tcp_flags, ip_version "
                "FROM (" + fx.PACKETS_SQL + ") t WHERE ip_version = 4 AND protocol IN (6, 17)")


@register("frames_decoded", ETHERNET_SQL)
def q_frames_decoded(spark, sf_dir):
    """Ethernet frames in a table column decoded with mapInPandas; the length is the whole frame's."""
    return cap.decode_frames(ethernet_frames(fx.packets(spark, sf_dir)))
