from __future__ import annotations

from pyspark.sql import functions as F

from .quality import judge, train
from .registry import query, table

#: Labelled rows that the classifier is fitted on, at most.
SAMPLE = 1500
#: Texts of a lower probability of good quality are rejected.
THRESHOLD = 0.5


@query("op5_quality")
def op5_quality(spark, folder):
    """Base figures of every document and the verdict of the trained classifier."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = train(docs, table(spark, folder, "labels"), SAMPLE)
    return judge(docs, model, THRESHOLD).drop("text").withColumn("quality", F.round("quality", 6))
