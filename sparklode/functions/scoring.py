"""Points, ladders and curves as column expressions. Rules that round half to even use bround, half up round or floor."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# All thresholds, rates and bounds of the ladders, multipliers and curves below.


def ladder(value: Column, steps: list[tuple[float, object]], otherwise: object) -> Column:
    """The first step whose bound `value` reaches."""
    (bound, result), *rest = steps
    out = F.when(value >= bound, F.lit(result))
    for bound, result in rest:
        out = out.when(value >= bound, F.lit(result))
    return out.otherwise(F.lit(otherwise))


def easy_decay(earlier: Column) -> Column:
    """Full points for the first five easy items of a day, half for ten more, then a tenth."""
    return ladder(earlier, [(15, 0.1), (5, 0.5)], 1.0)


def difficulty_from_share(share: Column) -> Column:
    """1 (nearly all solve it) to 5."""
    return ladder(share, [(0.9, 1), (0.7, 2), (0.5, 3), (0.3, 4)], 5)


def penalty_seconds(failures: Column) -> Column:
    return ladder(failures, [(10, 3600), (5, 300), (3, 60)], 0)


def xp_for_level(level: Column) -> Column:
    return 100 * F.pow(F.greatest(level - 1, F.lit(0)), F.lit(1.5))


def level_for_xp(xp: Column) -> Column:
    """The highest level whose threshold `xp` reaches; the power's rounding is corrected by one step either way."""
    guess = F.floor(F.pow(F.greatest(xp, F.lit(0)) / 100, F.lit(2 / 3))) + 1
    return F.when(xp_for_level(guess + 1) <= xp, guess + 1).when(xp_for_level(guess) > xp, guess - 1).otherwise(guess)


def xp_by_type(kind: Column) -> Column:
    return F.when(kind == "purchase", 50).when(kind == "signup", 30).when(kind == "click", 10).when(kind == "view", 5).otherwise(0)


def half_up(value: Column) -> Column:
    """Whole number, halves away from zero for values of zero or more."""
    return F.floor(value + 0.5)


def clamp(value: Column, low: float = 0, high: float = 100) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def mastery(solved: Column, attempted: Column, hard: Column) -> Column:
    """An ordered rule table: the first that holds."""
    share = F.when(attempted > 0, solved / attempted).otherwise(0.0)
    return (
        F.when((solved >= 20) & (share >= 0.8) & (hard >= 3), "master")
        .when((solved >= 10) & (share >= 0.6), "confident")
        .when(solved >= 3, "learning")
        .when(attempted > 0, "started")
        .otherwise("new")
    )


def combo(streak: Column) -> Column:
    return ladder(streak, [(10, 2.0), (5, 1.5), (3, 1.2)], 1.0)


def speed_bonus(elapsed_s: Column, limit_s: Column, most: int = 50) -> Column:
    """Linear from `most` at once to nothing at the limit, rounded half up."""
    return half_up(clamp(1 - elapsed_s / limit_s, 0, 1) * most)


def question_points(base: Column, elapsed_s: Column, limit_s: Column, streak: Column) -> Column:
    return half_up((base + speed_bonus(elapsed_s, limit_s)) * combo(streak))


def exam_points(kind: Column, right: Column, wrong: Column, total: Column, points: Column, penalty: Column) -> Column:
    """Partial credit to two decimals, half up: all or nothing for single and short, by parts for multi and match."""
    parts = F.greatest(right - F.when(kind == "multi", wrong).otherwise(F.lit(0)), F.lit(0)) / F.greatest(total, F.lit(1)) * points
    whole = F.when((right == total) & (wrong == 0), points).otherwise(-penalty)
    blank = (right + wrong) == 0
    return F.round(F.when(blank, F.lit(0)).when(kind.isin("multi", "match"), parts).otherwise(whole).cast("decimal(18,6)"), 2)


def item_result(kind: Column, given: Column, accepted: Column, marked: Column, correct: Column, options: Column, answers: Column, truth: Column, cents: Column, wrong_cents: Column, penalised: Column) -> Column:
    """(cents, is_correct) of one exam item, by kind: short_text, single, multi, match, number; points are in hundredths.

    `given` answers short_text and number, `marked` (numbers) single and multi, `answers` (aligned with `truth`) match. No answer
    gives 0 and a null verdict, never a penalty. A wrong short or single answer costs `wrong_cents`. multi gives a share for each
    right mark and, if `penalised`, takes one for each wrong mark, not below 0; match gives shares only; a wrong number gives 0.
    Shares are whole numbers over one denominator, so that halves go up exactly.
    """
    folded = F.lower(F.trim(given))
    blank = F.when(kind.isin("short_text", "number"), F.coalesce(folded, F.lit("")) == "").when(kind == "match", F.size(F.array_compact(answers)) == 0).otherwise(F.size(marked) == 0)
    short = F.exists(accepted, lambda a: F.lower(F.trim(a)) == folded)
    single = (F.size(marked) == 1) & F.arrays_overlap(marked, correct)
    number = folded.try_cast("double") == F.element_at(correct, 1)
    known = F.array_intersect(marked, options)
    others = F.size(F.array_except(options, correct))
    right, wrong = F.size(F.array_intersect(known, correct)), F.size(F.array_except(known, correct))
    fine = penalised & (others > 0)
    share = F.when(fine, right * others - wrong * F.size(correct)).otherwise(right)
    of = F.size(correct) * F.when(fine, others).otherwise(1)
    pairs = F.size(F.filter(F.zip_with(answers, truth, lambda a, b: a == b), lambda same: same))
    up = lambda top, below: F.floor((2 * cents * F.greatest(top, F.lit(0)) + below) / (2 * F.greatest(below, F.lit(1))))
    points = (
        F.when(blank, F.lit(0))
        .when(kind == "short_text", F.when(short, cents).otherwise(-wrong_cents))
        .when(kind == "single", F.when(single, cents).otherwise(-wrong_cents))
        .when(kind == "multi", up(share, of))
        .when(kind == "match", up(pairs, F.size(truth)))
        .otherwise(F.when(number, cents).otherwise(0))
    )
    full = F.when(kind == "short_text", short).when(kind == "single", single).when(kind == "multi", share == of).when(kind == "match", pairs == F.size(truth)).otherwise(number)
    return F.struct(points.cast("long").alias("cents"), F.when(~blank, F.coalesce(full, F.lit(False))).alias("is_correct"))


def accuracy_multiplier(right: Column, wrong: Column) -> Column:
    """1 from 85 % right among the answered, 0.3 up to 50 %, linear between; 1 without answers."""
    share = right / F.greatest(right + wrong, F.lit(1))
    return F.when(right + wrong <= 0, 1.0).otherwise(0.3 + 0.7 * clamp((share - 0.5) / 0.35, 0, 1))


def time_bonus(step: Column, scale: Column, cap: Column, given_so_far: Column) -> Column:
    """Seconds for a right answer: the scaled step, half up, as far as the run's cap leaves room."""
    return F.greatest(F.lit(0), F.least(half_up(step * scale), F.greatest(F.lit(0), cap - given_so_far)))
