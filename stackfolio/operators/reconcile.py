"""Matching of titles with another catalogue."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rows import rows_of
from ..functions.text import words
from ..session import written


def _agreeing(prefix: str, props: list[str]) -> Column:
    """One text for each set of properties that a row has, so that rows that agree in a set have a text in common."""
    texts = []
    for size in range(len(props) + 1):
        for chosen in combinations(range(len(props)), size):
            values = F.to_json(F.struct(*[F.col(f"{prefix}{props[i]}").alias(str(i)) for i in chosen])) if chosen else F.lit("")
            known = [F.col(f"{prefix}{props[i]}").isNotNull() for i in chosen]
            text = F.concat(F.lit(f"{','.join(map(str, chosen))}:"), values)
            for k in known:
                text = F.when(k, text)
            texts.append(text)
    return F.filter(F.array(*texts), lambda t: t.isNotNull())


def _weight(text: Column, props: dict[str, float]) -> Column:
    """Weight of the properties in the set of a text."""
    inside = F.split(F.substring_index(text, ":", 1), ",")
    parts = [F.when(F.array_contains(inside, str(i)), F.lit(float(w))).otherwise(F.lit(0.0)) for i, w in enumerate(props.values())]
    return sum(parts, F.lit(0.0))


class Candidates:
    """Classes of records, the titles that may match them, and the pairs of both.

    A record's best title agrees with it in some set of the properties, so for each set the best title
    that agrees in it is enough, and of the score only the weight of the set counts: the set of the best
    title gives the best score, the others no more. Records with equal words that agree in a set are one
    class of it. So a word and a set make a pair for each title and class, never for each record.
    """

    def __init__(
        self, records: DataFrame, catalogue: DataFrame, rec_id: str, rec_title: str, cat_id: str, cat_title: str,
        props: list[str], min_overlap: float,
    ):
        self.min_overlap = min_overlap
        listed = lambda title: F.array_sort(F.array_distinct(words(F.col(title))))
        kinds = {p: records.schema[p].dataType for p in props}
        self.rec = records.select(
            F.col(rec_id).alias("_rec"), listed(rec_title).alias("_words"), *[F.col(p).alias(f"_r_{p}") for p in props]
        ).where(F.size("_words") > 0).withColumn("_set", F.explode(_agreeing("_r_", props))).select(
            "_rec", "_words", "_set", F.sha2(F.concat(F.array_join("_words", " "), F.lit("|"), F.col("_set")), 256).alias("_class")
        )
        self.classes = self.rec.groupBy("_class").agg(F.any_value("_words").alias("_words"), F.any_value("_set").alias("_set"))
        self.rec_words = rows_of(self.classes, ["_class", "_set"], "_words", "_word")
        used = self.rec_words.select(F.col("_word").alias("_w")).distinct()
        cat = catalogue.select(
            F.col(cat_id).alias("_cat"), listed(cat_title).alias("_cwords"), *[F.col(p).cast(kinds[p]).alias(f"_c_{p}") for p in props]
        ).select("_cat", "_cwords", F.size("_cwords").alias("_m"), _agreeing("_c_", props).alias("_sets"))
        # titles are read and split once; what is written has the words that records have
        postings = rows_of(cat, ["_cat", "_m", "_sets"], "_cwords", "_word")
        self.postings = written(postings.join(used, F.col("_word") == F.col("_w"), "left_semi"), "reconcile-postings")

    def pairs(self) -> DataFrame:
        """(_class, _cat): titles that share one of the class's rarest words and are long enough.

        Of n words, a match of at least ``min_overlap`` shares one of the n - ceil(min_overlap n) + 1
        rarest and has at least ceil(min_overlap n) words itself.
        """
        frequency = self.postings.groupBy(F.col("_word").alias("_f")).agg(F.count(F.lit(1)).alias("_n"))
        # Words of one title come from one row, so the list per class is no longer than the title.
        rarest = (
            self.rec_words.join(frequency, F.col("_word") == F.col("_f"), "left")
            .groupBy("_class", "_set")
            .agg(F.array_sort(F.collect_list(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_word"))).alias("_by"))
        )
        size = F.size("_by")
        need = F.ceil(F.lit(self.min_overlap) * size - F.lit(1e-9)).cast("int")
        prefix = rarest.select("_class", "_set", need.alias("_need"), F.explode(F.slice("_by", 1, size - need + 1)).alias("p")).select(
            "_class", F.col("_set").alias("_ps"), "_need", F.col("p._word").alias("_pw")
        )
        asked = prefix.select(F.col("_pw").alias("_aw")).distinct()
        posts = self.postings.join(asked, F.col("_word") == F.col("_aw"), "left_semi")
        posts = posts.select("_word", "_cat", "_m", F.explode("_sets").alias("_set"))
        met = posts.join(prefix, (F.col("_word") == F.col("_pw")) & (F.col("_set") == F.col("_ps")) & (F.col("_m") >= F.col("_need")))
        return met.select("_class", "_cat").distinct()

    def best(self) -> DataFrame:
        """(_class, _cat, overlap): the title with most words of each class, the smallest id of equal ones."""
        pairs = self.pairs()
        lists = self.postings.groupBy("_cat").agg(F.collect_list("_word").alias("_cwords"))  # of one title: one row before
        overlap = F.size(F.array_intersect("_words", "_cwords")) / F.size("_words")
        scored = (
            pairs.join(self.classes.select("_class", "_words"), "_class").join(lists, "_cat")
            .select("_class", "_cat", overlap.alias("overlap")).where(F.col("overlap") >= self.min_overlap - 1e-9)
        )
        return scored.groupBy("_class").agg(F.min_by(F.struct("_cat", "overlap"), F.struct(-F.col("overlap"), F.col("_cat"))).alias("b")).select(
            "_class", "b.*"
        )


def reconcile(
    records: DataFrame, catalogue: DataFrame, rec_id: str, rec_title: str, cat_id: str, cat_title: str,
    props: dict[str, float] | None = None, min_overlap: float = 0.8,
) -> DataFrame:
    """Best catalogue record of each record: (rec_id, cat_id, overlap, score).

    ``overlap`` is the share of the record's different title words that the catalogue title has; pairs
    below ``min_overlap`` are no candidates. ``score`` adds the weight of each equal property
    (``props``, same column name on both sides, weights not below 0). Ties go to the smaller catalogue id.
    """
    props = props or {}
    if any(w < 0 for w in props.values()):
        raise ValueError("weights of properties must not be below 0")
    found = Candidates(records, catalogue, rec_id, rec_title, cat_id, cat_title, list(props), min_overlap)
    score = F.col("overlap") + _weight(F.col("_set"), props)
    scored = found.rec.select("_rec", "_set", "_class").join(found.best(), "_class").withColumn("score", score)
    best = scored.groupBy("_rec").agg(
        F.min_by(F.struct("_cat", "overlap", "score"), F.struct(-F.col("score"), F.col("_cat"))).alias("b")
    )
    return best.select(F.col("_rec").alias(rec_id), F.col("b._cat").alias(cat_id), "b.overlap", "b.score")
