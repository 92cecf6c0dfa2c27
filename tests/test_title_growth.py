"""Title lookups meet few titles beside the true ones."""

import random

from pyspark.sql import functions as F

from conftest import make_books
from kinshelf.operators import lookup


def test_title_lookup_meets_few_titles_beside_the_true_ones(spark, tmp_path):
    rng = random.Random(9)
    texts = sorted({"".join(rng.choices("the and ing re on ess tion ar of ly st en".split(), k=14)) for _ in range(400)})
    books = make_books(spark, [(i, t, "d", "A", None) for i, t in enumerate(texts)])
    index = lookup.TitleIndex.build(books, str(tmp_path / "t"))
    needles = spark.createDataFrame([(t[4:24],) for t in texts], "needle string").distinct()
    met = index.around(needles, "needle").distinct()
    true = met.join(index.texts, "id").where(F.contains("lower_title", "needle")).count()
    assert len(texts) <= true and met.count() < 4 * true
    hays = spark.createDataFrame([(t + " and other stories",) for t in texts], "hay string")
    assert index.anchors.within(hays, "hay").distinct().count() < 4 * len(texts)
