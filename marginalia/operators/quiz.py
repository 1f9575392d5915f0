"""Quiz grading, attempts and quiz statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.grading import expected_answer, feedback, grade_choice, grade_short_answer
from ..functions.text import blank_safe
from .skew import first_per_key


def last_submission(submitted: DataFrame, keys: list[str], newest_first: list[Column]) -> DataFrame:
    """J-12: the last submission per question wins."""
    return first_per_key(submitted, keys, newest_first)


def match_submissions(questions: DataFrame, submitted: DataFrame, keys: list[str]) -> DataFrame:
    """J-12: every question once; unanswered ones stay with null answers."""
    return questions.join(submitted, keys, "left")


def unknown_submissions(submitted: DataFrame, scope: DataFrame, keys: list[str]) -> DataFrame:
    """J-13 / X-03: submissions that answer nothing in scope."""
    return submitted.join(scope.select(*keys).distinct(), keys, "left_anti")


def grade_answers(matched: DataFrame) -> DataFrame:
    """G-09: verdict per row; the field that does not belong to the kind is cleared.

    Expects kind, selected_option_id, answer_text, correct_option_id,
    correct_answer_text, accepted_answers, options, explanation.
    """
    written = F.col("kind") == "short_answer"
    short = grade_short_answer(F.col("answer_text"), F.col("accepted_answers"))
    choice = grade_choice(F.col("selected_option_id"), F.col("correct_option_id"))
    expected = expected_answer(F.col("kind"), F.col("options"), F.col("correct_option_id"), F.col("correct_answer_text"))
    return (
        matched.withColumn("_short", F.when(written, short))
        .withColumn("is_correct", F.when(written, F.col("_short.is_correct")).otherwise(choice))
        .withColumn("matched_answer", F.col("_short.matched_answer"))
        .withColumn("overlap", F.coalesce(F.col("_short.overlap"), F.lit(0.0)))
        .withColumn("expected", expected)
        .withColumn("feedback", feedback(F.col("kind"), F.col("explanation"), F.col("expected")))
        .withColumn("selected_option_id", F.when(~written, F.col("selected_option_id")))
        .withColumn("answer_text", F.when(written, F.col("answer_text")))
        .drop("_short")
    )


def score_attempts(graded: DataFrame) -> DataFrame:
    """A-10: correct, total, share and the missed question numbers in order.

    A quiz holds at most 30 questions, which bounds the collected list.
    """
    missed = F.when(~F.col("is_correct"), F.col("question_no"))
    return graded.groupBy("attempt_id").agg(
        F.sum(F.col("is_correct").cast("int")).alias("correct"),
        F.count(F.lit(1)).alias("total"),
        (F.sum(F.col("is_correct").cast("int")) / F.count(F.lit(1))).alias("score"),
        F.array_sort(F.collect_list(missed)).alias("missed"),
    )


def retry_scope(scores: DataFrame, questions: DataFrame) -> DataFrame:
    """J-14: questions missed in an attempt that still exist, in quiz order."""
    missed = scores.select("attempt_id", F.explode(F.array_distinct("missed")).alias("question_no"))
    return missed.join(questions, ["attempt_id", "question_no"], "left_semi")


def attempt_detail(scores: DataFrame, answers: DataFrame) -> DataFrame:
    """J-15: ordered question ids of an attempt with their stored verdicts."""
    ids = scores.select("attempt_id", F.posexplode("question_ids").alias("position", "question_no"))
    stored = answers.select("attempt_id", "question_no", "is_correct")
    return ids.join(stored, ["attempt_id", "question_no"], "left")


def quiz_list(quizzes: DataFrame, attempts: DataFrame) -> DataFrame:
    """A-08: attempts, best score (full attempts first) and last attempt per quiz."""
    tried = attempts.groupBy("quiz_id").agg(
        F.count(F.lit(1)).alias("attempt_count"),
        F.coalesce(F.max(F.when(F.col("mode") == "full", F.col("score"))), F.max("score")).alias("best_score"),
        F.max("finished_at").alias("last_attempted_at"),
    )
    return quizzes.join(tried, "quiz_id", "left").fillna(0, ["attempt_count"])


def attempt_history(attempts: DataFrame) -> DataFrame:
    """A-09: attempt summaries with the best score of their quiz (full attempts first) alongside."""
    full = F.max(F.when(F.col("mode") == "full", F.col("score")))
    best = attempts.groupBy("quiz_id").agg(F.coalesce(full, F.max("score")).alias("quiz_best_score"))
    shown = attempts.withColumn("missed_count", F.size("missed"))
    return shown.join(best, "quiz_id")


def by_difficulty(graded: DataFrame, keys: list[str]) -> DataFrame:
    """A-11: correct / total for every difficulty, zero-filled."""
    tiers = F.explode(F.array(*[F.lit(d) for d in K.DIFFICULTIES])).alias("difficulty")
    counts = graded.groupBy(*keys, "difficulty").agg(
        F.sum(F.col("is_correct").cast("int")).alias("correct"), F.count(F.lit(1)).alias("total")
    )
    groups = graded.select(*keys).distinct().select(*keys, tiers)
    return groups.join(counts, [*keys, "difficulty"], "left").fillna(0, ["correct", "total"])


def mixes(questions: DataFrame) -> DataFrame:
    """A-13: question count per difficulty and kind of each quiz, as maps."""

    def counts(column: str, domain: list[str]) -> Column:
        pairs = [F.struct(F.lit(v), F.sum((F.col(column) == v).cast("int"))) for v in domain]
        return F.map_filter(F.map_from_entries(F.array(*pairs)), lambda _, n: n > 0)

    return questions.groupBy("quiz_id").agg(
        counts("difficulty", K.DIFFICULTIES).alias("difficulty_mix"), counts("kind", K.QUESTION_KINDS).alias("kind_mix")
    )


def public_questions(questions: DataFrame) -> DataFrame:
    """G-10: what a quiz taker may see; the citation keeps only its pointer."""
    visible = ["question_id", "quiz_id", "question_no", "prompt", "kind", "difficulty", "options"]
    pointer = F.col("citation").withField("snippet", F.lit(""))
    return questions.select(*visible, pointer.alias("citation"))


def started_at(raw: Column, finished_at: Column) -> Column:
    """G-11: lenient start time, never after the finish."""
    parsed = F.try_to_timestamp(blank_safe(raw))
    return F.least(F.coalesce(parsed, finished_at), finished_at)
