"""Toxic documents are rejected, clean ones stay; on labels that the model has not seen."""

import numpy as np
from pyspark.sql import functions as F

from lakeops.llm import quality_model


def test_toxic_documents_are_rejected(spark, sf):
    sf = sf.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality_model.fit(docs, labels.where("doc_id % 3 <> 0"), rows=2000)
    graded = quality_model.grade(docs.join(labels.where("doc_id % 3 = 0"), "doc_id"), model, at_least=2, tail=model.cut)
    rows = graded.where(F.length("text") > 60).select("quality", "toxic", "graded.*").collect()
    kept = {n: np.mean([r.kept for r in rows if (r.quality, r.toxic) == n]) for n in [(1, 0), (1, 1)]}
    low = np.mean([r.kept for r in rows if r.quality == 0])
    print("kept: clean", kept[1, 0], "toxic", kept[1, 1], "low", low, "cut", model.cut)
    # About three in ten toxic documents have no word that tells them from clean ones.
    assert kept[1, 0] > 0.98 and kept[1, 1] < 0.4 and low < 0.1
