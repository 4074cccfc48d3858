"""Rules, ensemble decision and verdict merge.

All of it is Column arithmetic evaluated inside whole-stage codegen; lookups
(J1-J3) are literal maps (``create_map`` + ``coalesce``), so no join runs.
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.columns import round_bin
from ..config import Thresholds


def _f(name: str, default: float = 0.0) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(default))


# ---------------------------------------------------------------- P12-P14
def dos_rule() -> Column:
    """SYN flood, packet/byte rate, or RST storm."""
    syn, ack, rst = _f("syn_flag_count"), _f("ack_flag_count"), _f("rst_flag_count")
    dur = _f("flow_duration", 1e6) / F.lit(1e6)
    return (((syn > 100) & (ack < syn * 0.1) & (dur < 5))
            | (_f("flow_packets_s") > 50000) | (_f("flow_bytes_s") > 100_000_000)
            | ((rst > 200) & (dur < 10)))


def portscan_rule() -> Column:
    """Many small forward packets with almost no reply, or SYNs with no reply."""
    nf, nb = _f("total_fwd_packets"), _f("total_backward_packets")
    return (((nf > 20) & (nb < 3) & (_f("fwd_packet_length_mean") < 100))
            | ((_f("syn_flag_count") > 30) & (nb < 5)))


def infiltration_rule() -> Column:
    """Backward bytes dwarf forward bytes over more than ten replies."""
    return ((_f("total_length_bwd_packets") > _f("total_length_fwd_packets") * 15)
            & (_f("total_backward_packets") > 10))


@dataclass(frozen=True)
class Rule:
    name: str
    label: str
    predicate: Callable[[], Column]
    priority: int


_RULES: list[Rule] = []


def register_rule(name: str, predicate: Callable[[], Column], priority: int, label: str | None = None) -> None:
    """Add a rule; lower priority fires first; ``predicate`` builds a boolean Column."""
    _RULES[:] = [r for r in _RULES if r.name != name]
    _RULES.append(Rule(name, label or name, predicate, priority))
    _RULES.sort(key=lambda r: r.priority)


def rules() -> list[Rule]:
    return list(_RULES)


register_rule("DoS/DDoS", dos_rule, 10)
register_rule("PortScan", portscan_rule, 20)
register_rule("Infiltration", infiltration_rule, 30)


def rule_label(rule_list: list[Rule] | None = None) -> Column:
    """First matching rule in priority order, else null."""
    rl = rule_list if rule_list is not None else rules()
    if not rl:
        return F.lit(None).cast("string")
    return F.coalesce(*[F.when(r.predicate(), F.lit(r.label)) for r in rl])


# ---------------------------------------------------------------- J1-J3
def _lit_map(d: dict) -> Column:
    items = []
    for k, v in d.items():
        items += [F.lit(k), F.lit(v)]
    return F.create_map(*items)


def severity_of(label: Column) -> Column:
    """Severity by label, default LOW."""
    return F.coalesce(_lit_map({k: v[0] for k, v in config.SEVERITY.items()})[label],
                      F.lit(config.DEFAULT_SEVERITY[0]))


def icon_of(label: Column) -> Column:
    """Icon by label, default info sign."""
    return F.coalesce(_lit_map({k: v[1] for k, v in config.SEVERITY.items()})[label],
                      F.lit(config.DEFAULT_SEVERITY[1]))


def recommendation_of(label: Column) -> Column:
    """Recommendation by label, default empty."""
    return F.coalesce(_lit_map(config.RECOMMENDATIONS)[label], F.lit(""))


def label_name(label_id: Column, labels: dict | None = None) -> Column:
    """Class id -> label name, default Unknown."""
    return F.coalesce(_lit_map(labels or config.ATTACK_LABELS)[label_id], F.lit("Unknown"))


# ---------------------------------------------------------------- P17
def no_model(df: DataFrame) -> DataFrame:
    """The ML result when no model is loaded."""
    return df.select("*", F.lit(config.NO_MODEL_LABEL).alias("ml_label"), F.lit(-1).alias("ml_label_id"),
                     F.lit(0.0).alias("ml_confidence"), F.lit(False).alias("ml_is_attack"),
                     F.create_map().cast("map<string,double>").alias("scores"))


# ---------------------------------------------------------------- P19/P20
def ensemble_decision(df: DataFrame, prob_col: str = "probability", iso_col: str = "iso_score",
                      th: Thresholds = Thresholds()) -> DataFrame:
    """P19 + P20: tree probabilities + isolation score -> ML result columns.

    ``prob_col`` is ``array<double>`` (class i at index i); argmax is the
    first maximum.  Adds ``ml_label ml_label_id ml_confidence ml_is_attack
    scores`` (``scores`` = label -> probability, 4 dp, plus ``Anomaly(IF)``).
    """
    p = F.col(prob_col)
    xconf = F.array_max(p)
    xc = (F.array_position(p, xconf) - 1).cast("int")
    iso_np = F.least(F.greatest((F.col(iso_col) + F.lit(0.7)) / F.lit(0.8), F.lit(0.0)), F.lit(1.0))
    blended = F.lit(th.w_trees) * xconf + F.lit(th.w_iso) * (F.lit(1.0) - iso_np)
    anomalous = (xc == 0) & (iso_np < th.iso_low) if th.anomaly_enabled else F.lit(False)
    fc0 = F.when(anomalous, F.lit(4)).otherwise(xc)
    fconf = (F.when(anomalous, blended)
             .when(xc != 0, F.least(F.greatest(blended, F.lit(0.0)), F.lit(1.0)))
             .otherwise(xconf))
    fc = F.when((fconf < th.confidence) & (fc0 != 0), F.lit(4)).otherwise(fc0)
    labels = th.labels
    n = len(labels)
    names = F.array(*[F.lit(labels.get(i, f"C{i}")) for i in range(n)])
    probs = F.slice(p, 1, n)
    score_keys = F.concat(F.slice(names, 1, F.size(probs)), F.array(F.lit("Anomaly(IF)")))
    score_vals = F.concat(F.transform(probs, lambda x: round_bin(x, 4)), F.array(round_bin(F.lit(1.0) - iso_np, 4)))
    return df.select("*", label_name(fc, labels).alias("ml_label"), fc.alias("ml_label_id"),
                     round_bin(fconf, 3).alias("ml_confidence"), (fc != 0).alias("ml_is_attack"),
                     F.map_from_arrays(score_keys, score_vals).alias("scores"))


# ---------------------------------------------------------------- P16 + J1/J2
def classify(df: DataFrame, rule_list: list[Rule] | None = None,
             override_conf: float = config.RULE_OVERRIDE_CONF) -> DataFrame:
    """P15 + P16: merge the first matching rule with the ML result.

    Needs the ML columns (``no_model`` or ``ensemble_decision``).  Rule and ML
    attack -> rule; rule, ML benign and confidence below ``override_conf`` ->
    rule; else the ML label.  ``confidence`` stays the ML one.
    """
    rl = rule_label(rule_list)
    d = df.withColumn("rule_label", rl)
    r = F.col("rule_label")
    final = (F.when(r.isNotNull() & F.col("ml_is_attack"), r)
             .when(r.isNotNull() & ~F.col("ml_is_attack") & (F.col("ml_confidence") < override_conf), r)
             .otherwise(F.col("ml_label")))
    # exploded from an array of one: a filter on the label stays above it, instead of copying all that it is made from into itself
    d = d.withColumn("label", F.explode(F.array(final)))
    lab = F.col("label")
    return d.select("*", severity_of(lab).alias("severity"), icon_of(lab).alias("severity_icon"),
                    F.col("ml_confidence").alias("confidence"), (lab != "Normal").alias("is_attack"),
                    r.isNotNull().alias("rule_triggered"), recommendation_of(lab).alias("recommendation"))


# ---------------------------------------------------------------- F13 + P18
def reconstruction_score(err: Column, threshold: Column) -> Column:
    """min(err / max(2*thr, 1e-9), 1), 4 dp."""
    return round_bin(F.least(err / F.greatest(threshold * 2.0, F.lit(1e-9)), F.lit(1.0)), 4)


def zero_day_override(verdicts: DataFrame, err_col: str = "ae_error", threshold: float | Column = 0.0) -> DataFrame:
    """Reconstruction error above threshold on a non-attack verdict -> Zero-Day / CRITICAL.

    Adds ``ae_score`` and ``is_zero_day``; rewrites label, severity, icon,
    recommendation and ``is_attack`` where the override fires.
    """
    thr = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    err = F.col(err_col)
    d = verdicts.withColumn("ae_score", reconstruction_score(err, thr)).withColumn("is_zero_day", err > thr)
    fire = F.col("is_zero_day") & ~F.col("is_attack")
    zl = F.lit("Zero-Day")
    return d.select(
        *[c for c in d.columns if c not in ("label", "severity", "severity_icon", "recommendation", "is_attack")],
        F.when(fire, zl).otherwise(F.col("label")).alias("label"),
        F.when(fire, severity_of(zl)).otherwise(F.col("severity")).alias("severity"),
        F.when(fire, icon_of(zl)).otherwise(F.col("severity_icon")).alias("severity_icon"),
        F.when(fire, F.lit(config.ZERO_DAY_RECOMMENDATION)).otherwise(F.col("recommendation")).alias("recommendation"),
        (F.col("is_attack") | fire).alias("is_attack"))


VERDICT_COLS = ["flow_id", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "last_seen_us",
                "label", "severity", "severity_icon", "confidence", "is_attack", "rule_triggered",
                "recommendation", "ml_label"]
