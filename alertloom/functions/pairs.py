"""Expressions over an (anchor, candidate) pair of event structs.

The callables here are what reconstruction and the linker accept: they take two
struct columns and give back columns, so a decision is compiled with the plan.
"""

import math
from itertools import combinations

from pyspark.sql import Column, functions as F

from .. import schema as S
from .lookup import stage_ordinal
from .temporal import scaled_gap, seconds_between
from .text import is_multi_marker

FEATURES = [
    "time_delta_norm", "shared_src_ip", "shared_dst_ip", "shared_any_ip",
    "same_service", "same_predicted_type", "stage_progression",
]
ORDINALS = [S.UNKNOWN_ORDINAL, *S.STAGE_ORDINAL.values()]
FEATURE_INPUTS = [
    "timestamp", "src_ip", "dst_ip", "service", "predicted_attack_type", "predicted_kill_chain_stage",
]

RULE_INPUTS = ["timestamp", "src_ip", "dst_ip"]


def shares_ip(a: Column, c: Column, ignore_multi: bool = False) -> Column:
    """True when the address sets of both events meet. Collapsed bursts carry a
    ``MULTI`` marker that compares as an address unless ``ignore_multi`` is set."""
    met = F.lit(False)
    for x in ("src_ip", "dst_ip"):
        for y in ("src_ip", "dst_ip"):
            same = a[x] == c[y]
            if ignore_multi:
                same = same & ~is_multi_marker(a[x])
            met = met | F.coalesce(same, F.lit(False))
    return met


def _flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("float")


def pair_features(a: Column, c: Column) -> dict:
    """The seven link features, by name."""
    gap = seconds_between(a["timestamp"], c["timestamp"])
    step = stage_ordinal(c["predicted_kill_chain_stage"]) - stage_ordinal(a["predicted_kill_chain_stage"])
    values = [
        scaled_gap(gap).cast("float"),
        _flag(a["src_ip"] == c["src_ip"]),
        _flag(a["dst_ip"] == c["dst_ip"]),
        shares_ip(a, c).cast("float"),
        _flag(a["service"] == c["service"]),
        _flag(a["predicted_attack_type"] == c["predicted_attack_type"]),
        step.cast("float"),
    ]
    return dict(zip(FEATURES, values))


def link_reward(action: Column, truth: Column, false_negative: float = S.REWARD_FALSE_NEGATIVE) -> Column:
    linked = F.when(truth, F.lit(S.REWARD_TRUE_POSITIVE)).otherwise(F.lit(S.REWARD_FALSE_POSITIVE))
    left = F.when(truth, F.lit(false_negative)).otherwise(F.lit(S.REWARD_TRUE_NEGATIVE))
    return F.when(action, linked).otherwise(left)


def break_even(false_negative: float = S.REWARD_FALSE_NEGATIVE) -> float:
    """Link probability above which linking has the higher expected reward."""
    cost_of_link = S.REWARD_TRUE_NEGATIVE - S.REWARD_FALSE_POSITIVE
    gain_of_link = S.REWARD_TRUE_POSITIVE - false_negative
    return cost_of_link / (cost_of_link + gain_of_link)


def rule_decision(minutes: float = S.RULE_WINDOW_MINUTES, ignore_multi: bool = False):
    """Link when both events share an address and are at most ``minutes`` apart."""
    def decide(a: Column, c: Column) -> Column:
        near = seconds_between(a["timestamp"], c["timestamp"]) <= F.lit(minutes * 60.0)
        return near & shares_ip(a, c, ignore_multi)
    decide.keys = ["src_ip", "dst_ip"]  # a linked pair shares a value of them
    return decide


def score_decision(link_score, no_link_score):
    """Link when the link score is strictly higher; a tie means no link."""
    def decide(a: Column, c: Column) -> Column:
        return link_score(a, c) > no_link_score(a, c)
    return decide


class LinearDecision:
    """Decision of a logistic model: compare the margin with the logit of the threshold."""

    def __init__(self, weights: dict, intercept: float, threshold: float = 0.5):
        self.weights, self.intercept = dict(weights), float(intercept)
        self.cut = math.log(threshold / (1.0 - threshold))

    def __call__(self, a: Column, c: Column) -> Column:
        feats = pair_features(a, c)
        margin = F.lit(self.intercept)
        for name, w in self.weights.items():
            margin = margin + F.lit(float(w)) * feats[name].cast("double")
        return margin > F.lit(self.cut)

    def _reach(self, equal, step: int, window: float) -> float:
        """Longest gap in seconds at which a pair with these equalities and this step can link; negative for never."""
        w = lambda name: self.weights.get(name, 0.0)
        best = self.intercept + w("stage_progression") * step + max(w("time_delta_norm"), 0.0)
        gains = {"ip": w("shared_any_ip") + max(w("shared_src_ip"), 0.0) + max(w("shared_dst_ip"), 0.0),
                 "service": w("same_service"), "type": w("same_predicted_type")}
        slack = best + sum(gains[e] for e in equal) - self.cut
        if slack <= 0:
            return -1.0
        if w("time_delta_norm") >= 0:
            return window
        return min(window, slack / -w("time_delta_norm") * S.OPEN_WINDOW_SECONDS + 1.0)  # a second for single precision

    def blocks(self, window_us: int) -> list:
        """List entries (see ``match_links``) in which every pair that can link meets.

        A link needs enough weight from equal addresses, services or types; each combination that can suffice
        makes lists of the events that agree in it, as far back as its weight outlasts the gap. A combination whose
        reach a part of it has already gives nothing new. What can link without any equality is listed by the
        stages it needs.
        """
        window, steps = window_us / 1e6, [(x, y) for x in ORDINALS for y in ORDINALS]
        every = [e for n in range(4) for e in combinations(("ip", "service", "type"), n)]
        reach = {e: max(self._reach(e, y - x, window) for x, y in steps) for e in every}
        entries = []
        for e in every[1:]:
            if reach[e] > max([0.0, *[reach[o] for o in every if set(o) < set(e)]]):
                entries += [list_entry(key, reach[e] * 1e6) for key in self._keys(e)]
        stage = stage_ordinal(F.col("predicted_kill_chain_stage"))
        for x in ORDINALS:
            after = [y for y in ORDINALS if self._reach((), y - x, window) > 0]
            if after:
                far = max(self._reach((), y - x, window) for y in after)
                entries.append(list_entry(F.lit(f"after {x}"), far * 1e6, asks=stage.isin(after), holds=stage == x))
        return entries

    def _keys(self, equal) -> list:
        part = {"service": "service", "type": "predicted_attack_type"}
        named = [F.concat(F.lit(f"{e}="), F.col(part[e])) for e in equal if e != "ip"]
        if "ip" not in equal:
            return [F.concat(*named)]
        # the same address twice is one list
        second = F.when(~F.col("src_ip").eqNullSafe(F.col("dst_ip")), F.col("dst_ip"))
        return [F.concat(*named, F.lit("ip="), side) for side in (F.col("src_ip"), second)]


def list_entry(key: Column, window_us, asks: Column = None, holds: Column = None) -> Column:
    """An event's place in a list: it looks for anchors there if it ``asks`` and is one if it ``holds``. Null without key."""
    role = lambda x: F.lit(True) if x is None else F.coalesce(x, F.lit(False))
    entry = F.struct(key.cast("string").alias("key"), role(asks).alias("asks"), role(holds).alias("holds"),
                     F.lit(int(window_us)).cast("long").alias("reach_us"))
    return F.when(key.isNotNull() & (entry["asks"] | entry["holds"]), entry)


def linear_decision(weights: dict, intercept: float, threshold: float = 0.5) -> LinearDecision:
    return LinearDecision(weights, intercept, threshold)
