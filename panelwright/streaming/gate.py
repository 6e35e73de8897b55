"""The control gate over proposed portfolio decisions, as a batch query and as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


# fixed values: names and defaults of the limits
@dataclass(frozen=True)
class Limits:
    maximum_data_age_seconds: float = 4 * 86400.0
    maximum_gross_exposure: float = 1.0
    maximum_net_exposure: float = 1.0
    maximum_position_weight: float = 0.10
    maximum_turnover: float = 0.50
    maximum_notional: float = 1_000_000.0
    maximum_drawdown: float = 0.15
    maximum_daily_loss: float = 0.05

    def __post_init__(self):
        if not all(0 < v < float("inf") for v in vars(self).values()):
            raise ValueError("limits must be finite and positive")


def observed(decisions: DataFrame) -> DataFrame:
    """What a decision (decision_time, data_available_at, target_weights, current_weights, equity, previous_equity) shows by itself."""
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda t, x: t + x)
    sizes = F.transform(F.map_values("target_weights"), lambda x: F.abs(x))
    moved = F.map_values(F.map_zip_with("target_weights", "current_weights", lambda k, a, b: F.abs(F.coalesce(a, F.lit(0.0)) - F.coalesce(b, F.lit(0.0)))))
    finite = lambda m: ~F.exists(F.map_values(m), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = finite("target_weights") & finite("current_weights") & (F.col("equity") > 0) & (F.col("previous_equity") > 0) & F.col("decision_time").isNotNull() & F.col("data_available_at").isNotNull()
    return decisions.withColumns({
        "valid": F.coalesce(ok & (F.col("equity") < float("inf")) & (F.col("previous_equity") < float("inf")), F.lit(False)),
        "gross_exposure": add(sizes), "absolute_net_exposure": F.abs(add(F.map_values("target_weights"))), "position_weight": F.coalesce(F.array_max(sizes), F.lit(0.0)), "turnover": add(moved),
        "daily_return": F.col("equity") / F.col("previous_equity") - 1, "data_age_seconds": F.unix_micros(F.col("decision_time").cast("timestamp")) / 1e6 - F.unix_micros(F.col("data_available_at").cast("timestamp")) / 1e6,
    }).withColumn("notional", F.col("gross_exposure") * F.col("equity"))


def stateless_reasons(limits: Limits) -> list[Column]:
    c = F.col
    return [
        F.when(c("data_age_seconds") < 0, "future_data_availability").when(c("data_age_seconds") > limits.maximum_data_age_seconds, "stale_data"),
        F.when(c("gross_exposure") > limits.maximum_gross_exposure, "gross_exposure_limit"), F.when(c("absolute_net_exposure") > limits.maximum_net_exposure, "net_exposure_limit"),
        F.when(c("position_weight") > limits.maximum_position_weight, "position_limit"), F.when(c("turnover") > limits.maximum_turnover, "turnover_limit"), F.when(c("notional") > limits.maximum_notional, "notional_limit")]


#: What an audit row shows of a decision, and the column of observed() that holds it.
OBSERVED = {
    "gross_exposure": "gross_exposure", "absolute_net_exposure": "absolute_net_exposure", "maximum_position_weight": "position_weight", "turnover": "turnover", "notional": "notional",
    "drawdown": "drawdown", "daily_return": "daily_return", "data_age_seconds": "data_age_seconds",
}
_KIND = "map<string, double>"


def observed_map(but: str | None = None) -> Column:
    return F.create_map(*[x for name, c in OBSERVED.items() if name != but for x in (F.lit(name), F.col(c))])


def batch_gate(decisions: DataFrame, limits: Limits = Limits(), kill_from: str | None = None, ttl_days: float | None = None) -> DataFrame:
    """(portfolio, seq, decision_id, allowed, reasons, observed) of a finished table ordered by seq: a repeated id is rejected, an invalid
    decision takes its id but not the peak; both show nothing. With ttl_days an id is a repeat while so long has not passed, by decision
    time, since its last use before. kill_from names a column that is true from the kill switch on."""
    w = Window.partitionBy("portfolio")
    uses = Window.partitionBy("portfolio", "decision_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    time = F.unix_micros(F.col("decision_time").cast("timestamp"))
    repeat = F.count(F.lit(1)).over(uses) > 0
    if ttl_days is not None:
        # a decision without a time is no use that lasts, and repeats whatever came before
        repeat = F.when(F.col("decision_time").isNull(), repeat).otherwise(F.coalesce(F.max(time).over(uses) + int(ttl_days * 86_400e6) > time, F.lit(False)))
    df = observed(decisions).withColumn("repeat", repeat)
    counts = F.when(~F.col("repeat") & F.col("valid"), F.col("equity"))
    df = df.withColumn("drawdown", F.col("equity") / F.max(counts).over(w.orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)) - 1)
    reasons = F.array_compact(F.array(
        F.when(F.col(kill_from), "manual_kill_switch") if kill_from else F.lit(None).cast("string"), *stateless_reasons(limits),
        F.when(F.col("drawdown") < -limits.maximum_drawdown, "drawdown_limit"), F.when(F.col("daily_return") < -limits.maximum_daily_loss, "daily_loss_limit")))
    reasons = F.when(F.col("repeat"), F.array(F.lit("duplicate_decision_id"))).when(~F.col("valid"), F.array(F.lit("invalid_input"))).otherwise(reasons)
    shown = F.when(F.col("repeat") | ~F.col("valid"), F.create_map().cast(_KIND)).otherwise(observed_map())
    return df.select("portfolio", "seq", "decision_id", (F.size(reasons) == 0).alias("allowed"), reasons.alias("reasons"), shown.alias("observed"))


class Gate(StatefulProcessor):
    """Per portfolio: the peak of equity, the kill switch, and the ids seen with the time in ms until which they are repeats. With a time to
    live, a timer by event time, one a day, drops the ids that the watermark has passed."""

    DAY = 86_400_000

    def __init__(self, limits: Limits, ttl_ms: int | None):
        self.limits, self.ttl_ms = limits, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.peak = handle.getValueState("peak", "equity double")
        self.killed = handle.getValueState("killed", "on boolean")
        self.seen = handle.getMapState("seen", "decision_id string", "until long")

    def _repeats(self, decision_id: str, at: float) -> bool:
        """Whether the id is a repeat; its use is noted."""
        known = self.seen.containsKey((decision_id,))
        if self.ttl_ms is None:
            self.seen.updateValue((decision_id,), (0,))
            return known
        until = self.seen.getValue((decision_id,))[0] if known else -1
        if at != at:  # no time: no use that lasts
            if not known:
                self.seen.updateValue((decision_id,), (-1,))
            return known
        later = int(at) + self.ttl_ms
        if later > until:
            self.seen.updateValue((decision_id,), (later,))
            self.handle.registerTimer((later // self.DAY + 1) * self.DAY)
        return until > at

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        peak = self.peak.get()[0] if self.peak.exists() else None
        killed = self.killed.exists()
        for block in rows:
            out = []
            for r in block.sort_values("seq").itertuples():
                if r.kind == "kill":
                    killed = True
                    self.killed.update((True,))
                    continue
                if self._repeats(r.decision_id, r.at_ms):
                    out.append((r.seq, r.decision_id, ["duplicate_decision_id"], {}))
                    continue
                if not r.valid:
                    out.append((r.seq, r.decision_id, ["invalid_input"], {}))
                    continue
                peak = r.equity if peak is None else max(peak, r.equity)
                drawdown = r.equity / peak - 1
                reasons = (["manual_kill_switch"] if killed else []) + list(r.stateless)
                reasons += ["drawdown_limit"] if drawdown < -self.limits.maximum_drawdown else []
                reasons += ["daily_loss_limit"] if r.daily_return < -self.limits.maximum_daily_loss else []
                out.append((r.seq, r.decision_id, reasons, {**dict(r.shown), "drawdown": drawdown}))
            if out:
                yield pd.DataFrame({"portfolio": key[0], "seq": [o[0] for o in out], "decision_id": [o[1] for o in out], "allowed": [not o[2] for o in out], "reasons": [o[2] for o in out], "observed": [o[3] for o in out]})
        if peak is not None:
            self.peak.update((float(peak),))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        gone = [k for k, v in self.seen.iterator() if 0 <= v[0] <= expiredTimerInfo.getExpiryTimeInMs()]
        for k in gone:
            self.seen.removeKey(k)
        return iter(())

    def close(self) -> None:
        pass


def stream_gate(events: DataFrame, limits: Limits = Limits(), ttl_days: float | None = None, late: str = "1 day") -> DataFrame:
    """The gate over a stream of decisions and kill events (kind: decision or kill; portfolio, seq, ...). What needs no state is computed
    before the shuffle by portfolio. Needs the RocksDB state store.

    With ttl_days ids expire by event time, as in batch_gate(): a decision itself tells whether an id it repeats has expired, and timers
    only free the state once the watermark (late behind the latest decision time) has passed. Spark drops decisions that come later than
    the watermark; a decision dropped is one not allowed. A finite stream ends."""
    df = observed(events).withColumn("stateless", F.array_compact(F.array(*stateless_reasons(limits))))
    at = F.col("decision_time").cast("timestamp")
    own = ["portfolio", "seq", F.coalesce("kind", F.lit("decision")).alias("kind"), "decision_id", "valid", "equity", "daily_return", "stateless", observed_map(but="drawdown").alias("shown"), (F.unix_micros(at) / 1000).alias("at_ms")]
    rows = df.select(*own) if ttl_days is None else df.select(*own, at.alias("event_time")).withWatermark("event_time", late)
    return rows.groupBy("portfolio").transformWithStateInPandas(
        statefulProcessor=Gate(limits, None if ttl_days is None else int(ttl_days * 86_400_000)), outputStructType=f"portfolio long, seq long, decision_id string, allowed boolean, reasons array<string>, observed {_KIND}",
        outputMode="Append", timeMode="None" if ttl_days is None else "EventTime")
