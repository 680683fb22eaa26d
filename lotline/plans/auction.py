"""Sequential search for features by experts who bid their wealth on candidates."""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import InheritableThread
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import centered_power, hard_limits
from ..functions.special import slow_universal_pdf, universal_pdf
from ..operators.gram import Gram, grams
from ..operators.linear import Fit, FTest, fit, fit_rows, partial_f, sse_from
from ..operators.smooth import Spline, smoothing_spline
from .features import Feature, fit_powers, interaction
from .streams import Stream, product_with

#: What a calibrating expert bids, and its wealth.
CALIBRATION_BID, CALIBRATION_WEALTH = 5e-6, 100.0
#: What a win pays, taxes on bids and wins, and bids of forced features.
PAYOFF, BID_TAX, PAYOFF_TAX, FORCED = 0.05, 0.05, 0.40, 1.1
#: Candidates that one pass over the rows measures.
BATCH = 40


@dataclass
class History:
    """Bids that an expert has made, and how many since it last won."""

    bids: int = 0
    wins: int = 0
    since: int = 0
    last_won: bool = False
    #: whether the last round of all added a feature, and whether it was this expert's
    round_added: bool = False
    round_own: bool = False

    def note(self, won: bool) -> None:
        self.bids, self.wins = self.bids + 1, self.wins + won
        self.since, self.last_won = 0 if won else self.since + 1, won


def finite_bid(alpha: float, left: int, h: History) -> float:
    return min(0.25, alpha / left) if left else 0.0


def geometric_bid(rate: float) -> Callable[[float, int, History], float]:
    return lambda alpha, left, h: alpha * rate if left else 0.0


def universal_bid(alpha: float, left: int, h: History) -> float:
    return alpha * slow_universal_pdf(1 + h.since) if left else 0.0


def bounded_universal_bid(alpha: float, left: int, h: History) -> float:
    return min(0.25, alpha * max(1 / left, universal_pdf(1 + h.since))) if left else 0.0


def fixed_bid(amount: float) -> Callable[[float, int, History], float]:
    """A calibrating expert's: the same amount whenever it may bid."""
    return lambda alpha, left, h: amount if left else 0.0


def after_acceptance_bid(amount: float) -> Callable[[float, int, History], float]:
    """A fit bidder: the amount once after each acceptance that it is told of, else nothing."""
    return lambda alpha, left, h: amount if left and h.last_won else 0.0


def fit_bid(amount: float) -> Callable[[float, int, History], float]:
    """A calibrating expert's: the amount if the last round added another expert's feature, else nothing."""
    return lambda alpha, left, h: amount if left and h.round_added and not h.round_own else 0.0


@dataclass
class Expert:
    name: str
    alpha: float
    bidder: Callable[[float, int, History], float]
    stream: Stream
    role: str = "source"  # source, scavenger, calibrate or locked
    purgeable: bool = False
    history: History = field(default_factory=History)

    def bid(self) -> float:
        if self.idle():
            return 0.0
        return min(self.bidder(self.alpha, self.stream.remaining(), self.history), self.alpha / (1 + self.alpha))

    def idle(self) -> bool:
        """Whether it can offer nothing now."""
        return self.alpha < 1e-10 or self.stream.peek() is None

    def finished(self) -> bool:
        """Whether it can never offer anything again: a growing stream that is empty for now may."""
        return self.alpha < 1e-10 or self.stream.peek() is None and not self.stream.grows


class Model:
    """A least-squares model on estimation rows whose cross-products are measured BATCH candidates at a time.

    A pass measures the products of all terms and of the candidates that may be
    offered next, so most rounds need no pass. in_model holds the names of the
    terms, for streams that leave them out.
    """

    def __init__(self, df: DataFrame, y: Column, is_est: Column | None = None, weight: Column | None = None):
        self.df, self.y, self.is_est, self.weight = df, y, is_est, weight
        self.terms: list[Feature] = []
        self.in_model: set[str] = set()
        self.known: dict[str, Feature] = {}
        self.passes = 0
        self.measure([])

    def measure(self, candidates: list[Feature]) -> None:
        """One pass over the rows for the response, the terms and the candidates that aren't known yet."""
        self.use(*self.passed({f.name: f for f in [*self.terms, *candidates]}))

    def passed(self, known: dict[str, Feature]) -> tuple[dict[str, Feature], dict[int, Gram]]:
        """What a pass over the rows tells of the response and some features."""
        columns = {"__y": self.y, **{n: f.column for n, f in known.items()}}
        return known, grams(self.df, columns, self.weight, self.is_est.cast("int") if self.is_est is not None else None)

    def use(self, known: dict[str, Feature], parts: dict[int, Gram]) -> None:
        """Takes over what a pass told."""
        # a row left out for one candidate would be left out of the tests of all that share its pass
        nulls = sorted({n for g in parts.values() for n, k in g.nulls.items() if k})
        if nulls:
            raise ValueError(f"{nulls} have nulls; fill them and add indicators first")
        self.known = known
        self.est: Gram = parts.get(1 if self.is_est is not None else 0)
        self.val: Gram | None = parts.get(0) if self.is_est is not None else None
        self.passes += 1

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.terms]

    def fit(self) -> Fit:
        return fit(self.est, "__y", self.names)

    def fitted_powers(self, binary: bool = False) -> tuple[int, list[Feature]]:
        """The number of terms, and centred powers of the fit as it is now, for calibrating."""
        f = self.fit()
        made = fit_powers(f.predict({t.name: t.column for t in self.terms}), len(f.xs), binary)
        told = saved(self)
        for p, feature in enumerate(made, 2):
            feature.attrs.update({"of": told, "power": p, "binary": binary})
        return len(f.xs), made

    def fitted_spline(self, degrees: float = 5, binary: bool = False) -> tuple[int, list[Feature]]:
        """The number of terms, and a spline of the residuals on the fit as it is now, found on the estimation rows."""
        f = self.fit()
        fitted = f.predict({t.name: t.column for t in self.terms})
        fitted = hard_limits(fitted) if binary else fitted
        rows = self.df if self.is_est is None else self.df.where(self.is_est)
        spline = smoothing_spline(rows.select(fitted.alias("x"), (self.y - fitted).alias("y"), (F.lit(1.0) if self.weight is None else self.weight).alias("w")), "x", "y", degrees, "w")
        told = {"stream": "CALIBRATION", "of": saved(self), "spline": spline.stored(), "binary": binary}
        return len(f.xs), [Feature(f"Y_hat_spline_{len(f.xs)}", spline.column(fitted), told)]

    def test(self, features: list[Feature]) -> FTest:
        return partial_f(self.est, "__y", self.names, [f.name for f in features])

    def add(self, features: list[Feature]) -> None:
        self.terms += features
        self.in_model |= {f.name for f in features}

    def cvss(self) -> float:
        return sse_from(self.val, self.fit()) if self.val is not None else 0.0


class Ahead:
    """The pass after next, made in a thread under a job group of its own while rounds use the last one."""

    def __init__(self, model: Model):
        self.model, self.sc = model, model.df.sparkSession.sparkContext
        self.group, self.names, self.thread, self.told = "", frozenset(), None, None
        self.used = 0

    def begin(self, features: dict[str, Feature]) -> None:
        """Starts a pass over features, unless one is under way."""
        if self.thread is not None:
            return
        self.group, self.names, self.told = f"ahead-{uuid.uuid4().hex}", frozenset(features), None

        def work(group=self.group) -> None:
            self.sc.setJobGroup(group, "features of the next rounds", True)
            self.sc.setLocalProperty("spark.scheduler.pool", "ahead")
            try:
                self.told = self.model.passed(features)
            except Exception:  # cancelled, or it will fail again where its result is needed
                self.told = None

        self.thread = InheritableThread(target=work)
        self.thread.start()

    def take(self, needed: set[str]) -> bool:
        """Uses the pass if it tells all that is needed; one that doesn't is stale, and cancelled."""
        if self.thread is None:
            return False
        if not needed <= self.names:
            self.stop()
            return False
        self.thread.join()
        told, self.thread = self.told, None
        if told is None:
            return False
        self.model.use(*told)
        self.used += 1
        return True

    def stop(self) -> None:
        if self.thread is not None:
            self.sc.cancelJobGroup(self.group)
            self.thread.join()
            self.thread = None


class Auction:
    """Experts in turn win the right to have their feature tested; wins pay, losses cost what was bid.

    threaded: the pass that later rounds need is made while rounds go on with what
    the last one told. It covers what is known and not yet offered as well, so
    every round decides as it would without it.
    """

    def __init__(self, model: Model, experts: list[Expert], threaded: bool = False):
        self.model, self.experts = model, experts
        self.ahead = Ahead(model) if threaded else None
        self.rejected: list[Feature] = []
        self.log: list[dict] = []
        self.recovered = 0.0

    def force(self, features: list[Feature]) -> None:
        """Puts locked features in, whatever their test says, unless singular."""
        for f in features:
            self.model.measure([f])
            t = self.model.test([f])
            if not t.singular:
                self.model.add([f])
            self._note("LOCKED", f.name, FORCED, t, not t.singular)

    def round(self) -> bool:
        """One auction; False when no expert bids."""
        bids = [(e.bid(), e) for e in self.experts]
        calibrating = [(b, e) for b, e in bids if e.role == "calibrate" and b > 0]
        bid, winner = max(calibrating or bids, key=lambda x: x[0], default=(0.0, None))
        if winner is None or bid <= 0:
            return False
        scavengers = [e for e in self.experts if e.role == "scavenger" and e is not winner and not e.finished()]
        tax = bid * BID_TAX if scavengers else 0.0
        for e in scavengers:
            e.alpha += tax / len(scavengers)
        bundle = winner.stream.pop()
        if any(f.name not in self.model.known for f in bundle):
            # what may be offered next is measured in the same pass, each expert's first bundles before any's later ones
            queues = [e.stream.ahead(BATCH) for _, e in bids]
            later = [f for turn in itertools.zip_longest(*queues, fillvalue=[]) for b in turn for f in b]
            ahead = list({f.name: f for f in later if f.name not in self.model.in_model}.values())
            if self.ahead is None or not self.ahead.take({*self.model.names, *(f.name for f in bundle)}):
                self.model.measure([*bundle, *ahead[: max(0, BATCH - len(bundle))]])
            if self.ahead is not None:
                self._begin_next()
        t = self.model.test([f for f in bundle if f.name not in self.model.names] or bundle)
        accept = not t.singular and t.p < bid - tax
        winner.history.note(accept)
        for e in self.experts:
            e.history.round_added, e.history.round_own = accept, e is winner
        if accept:
            self.model.add([f for f in bundle if f.name not in self.model.names])
            self._reward(winner, bundle)
        else:
            winner.alpha -= bid * BID_TAX if t.singular else bid / (1 - bid)
            if winner.role != "calibrate" and t.p < 0.999:
                seen = {f.name for f in self.rejected}
                self.rejected += [f for f in bundle if f.name not in seen]
        self._note(winner.name, " + ".join(f.name for f in bundle), bid, t, accept)
        for e in [e for e in self.experts if e.purgeable and e.finished()]:
            self.recovered += max(e.alpha, 0.0)
            self.experts.remove(e)
        return True

    def _begin_next(self) -> None:
        """Starts the next pass: terms, what is known and may still be offered, and as much again of streams that don't depend on the model."""
        queues = [e.stream.ahead(2 * BATCH) for e in self.experts if not e.stream.grows]
        later = [f for turn in itertools.zip_longest(*queues, fillvalue=[]) for b in turn for f in b]
        new = list({f.name: f for f in later if f.name not in self.model.known}.values())
        if new:
            self.ahead.begin({f.name: f for f in [*self.model.terms, *self.model.known.values(), *new[:BATCH]]})

    def _reward(self, winner: Expert, bundle: list[Feature]) -> None:
        """Pays the winner and spends the tax on experts for products of the new features with the model's."""
        winner.alpha += PAYOFF * (1 - PAYOFF_TAX)
        if winner.role == "calibrate":
            return
        for f in bundle:
            others = [g for g in self.model.terms if g.name != f.name and "of" not in g.attrs]
            if others:
                self.experts.append(Expert(f"Cross[{f.name} x model]", PAYOFF * PAYOFF_TAX / len(bundle), finite_bid, product_with(f"Cross[{f.name}]", f, others), "scavenger", True))

    def _note(self, expert: str, feature: str, bid: float, t: FTest, accepted: bool) -> None:
        f = self.model.fit()
        self.log.append({"round": len(self.log), "expert": expert, "feature": feature, "bid": float(bid), "f": float(t.f), "p": float(t.p), "singular": t.singular, "accepted": accepted, "terms": len(f.xs), "rss": float(f.rss), "cvss": float(self.model.cvss()), "wealth": float(sum(e.alpha for e in self.experts))})

    def run(self, rounds: int) -> "Auction":
        """Rounds until none bids, few degrees of freedom are left, or validation errors grow by a tenth in a round."""
        for _ in range(rounds):
            before = self.log[-1]["cvss"] if self.log else 0.0
            if self.model.fit().df <= 10 or not self.round():
                break
            if before and self.log[-1]["cvss"] > 1.1 * before:
                break
        if self.ahead is not None:
            self.ahead.stop()
        return self

    def progress(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.log, "round int, expert string, feature string, bid double, f double, p double, singular boolean, accepted boolean, terms int, rss double, cvss double, wealth double")


def shares(alpha: float, locked: bool = False) -> dict[str, float]:
    """Wealth of the main, interaction and (with a locked stream) cross experts."""
    return {"main": 0.40 * alpha, "interaction": 0.31 * alpha, "cross": 0.29 * alpha} if locked else {"main": 0.6 * alpha, "interaction": 0.4 * alpha}


def saved(model: Model) -> list[dict]:
    """Terms with coefficients, as plain values that json can hold."""
    f = model.fit()
    return [{"term": n, "beta": float(b), "powers": list(map(list, t.powers)) if t else [], "attrs": t.attrs if t else {}} for n, b, t in zip(["Intercept", *f.xs], f.beta, [None, *model.terms])]


def restored(terms: list[dict], base: dict[str, Feature]) -> Column:
    """The fit of saved terms over a table's base features; powers of an earlier fit are made from its terms."""
    out = F.lit(0.0)
    for t in terms:
        if "of" in t["attrs"]:
            earlier, binary = restored(t["attrs"]["of"], base), t["attrs"]["binary"]
            if "spline" in t["attrs"]:
                out = out + t["beta"] * Spline.restored(t["attrs"]["spline"]).column(hard_limits(earlier) if binary else earlier)
                continue
            out = out + t["beta"] * centered_power(hard_limits(earlier) if binary else earlier, t["attrs"]["power"], 0.5 if binary else 0.0)
            continue
        f = None
        for name, k in t["powers"]:
            for _ in range(k):
                f = base[name] if f is None else interaction(f, base[name])
        out = out + (t["beta"] if f is None else t["beta"] * f.column)
    return out


def refitted(df: DataFrame, y: Column, terms: list[dict], base: dict[str, Feature], weight: Column | None = None) -> Fit:
    """A saved model's terms fitted anew to the rows of a table, in full precision; calibrating terms stay as they were."""
    columns = {t["term"]: restored([{**t, "beta": 1.0}], base) for t in terms if t["term"] != "Intercept"}
    return fit_rows(df, "__y", list(columns), columns | {"__y": y}, weight)


def reweighted(terms: list[dict], f: Fit) -> list[dict]:
    """Saved terms with the coefficients of a refit."""
    beta = dict(zip(["Intercept", *f.xs], f.beta))
    return [{**t, "beta": float(beta[t["term"]])} for t in terms]
