"""Searches whose hits are among the lowest ids do not look at the other books."""

from conftest import make_books
from kinshelf.operators import search
from kinshelf.operators.gram_index import GramIndex


def test_a_frequent_key_is_asked_among_the_lowest_ids_only(spark, monkeypatch, tmp_path):
    books = make_books(spark, [(i, f"common {i}", "rare" if i in (150, 180) else "d", "A", None) for i in range(-20, 200)])
    index = search.text_grams(books, str(tmp_path / "s"))
    asked, around = [], GramIndex.around

    def seen(self, needles, needle):
        asked.append({r[0] for r in needles.collect()})
        return around(self, needles, needle)

    monkeypatch.setattr(GramIndex, "around", seen)
    requests = spark.createDataFrame([(1, "common", 3), (2, "rare", 5), (3, "zzz", 1), (4, "Common 1", 9)], "request_id int, term string, hits bigint")
    got = sorted(map(tuple, search.search_hits(requests, books, index).collect()))
    assert got == sorted(map(tuple, search.search_hits(requests, books).collect())) and len(got) == 14
    assert asked == [{"common", "rare", "zzz", "common 1"}, {"rare", "zzz", "common 1"}]
