"""Source documents that are easy to misread: missing parts, ties, other languages, bodies that are no JSON."""

from __future__ import annotations

import datetime as dt
import json

from episodika.sources import normalise as n


def docs(spark, schema, rows, keys="series_id string"):
    df = spark.createDataFrame([(*r[:-1], r[-1] if isinstance(r[-1], str) or r[-1] is None else json.dumps(r[-1])) for r in rows], f"{keys}, body string")
    return n.parsed(df, schema)


def test_show_details(spark):
    show = {
        "name": "이름", "overview": "  text ", "tagline": " ", "poster_path": "/p.jpg", "vote_average": 0, "genres": [{"name": "A"}, {"name": ""}, {"id": 3}],
        "alternative_titles": {"results": [{"iso_3166_1": "KR", "title": "x"}, {"iso_3166_1": "FR", "title": "y"}, {"iso_3166_1": "US", "title": "x"}, {"iso_3166_1": "JP", "title": ""}]},
        "content_ratings": {"results": [{"iso_3166_1": "US", "rating": "TV"}, {"iso_3166_1": "KR", "rating": ""}, {"iso_3166_1": "KR", "rating": "15"}]},
        "videos": {"results": [
            {"key": "a", "site": "YouTube", "type": "Teaser", "iso_639_1": "ko", "official": True}, {"key": "b", "site": "Vimeo", "type": "Trailer", "iso_639_1": "ko", "official": True},
            {"key": "c", "site": "YouTube", "type": "Trailer", "iso_639_1": "en", "official": True}, {"key": "d", "site": "YouTube", "type": "Trailer", "iso_639_1": "en", "official": True},
        ]}, "external_ids": {"imdb_id": "tt1"}, "first_air_date": "2020-02-30",
    }
    rows = {r.series_id: r for r in n.show_details(docs(spark, n.SHOW, [("a", show), ("b", {}), ("c", "no json"), ("d", None)])).collect()}
    a = rows["a"]
    assert (a.title_ko, a.overview_ko, a.tagline_ko, a.genres_ko, a.alt_titles, a.content_rating_kr) == ("이름", "text", None, ["A"], ["x"], "15")
    assert (a.trailer_url, a.poster_url, a.vote_average, a.imdb_id, a.first_air_date) == ("https://www.youtube.com/watch?v=c", "https://image.tmdb.org/t/p/w500/p.jpg", None, "tt1", None)
    for name in "bcd":
        assert rows[name].trailer_url is None and rows[name].genres_ko == [] and rows[name].alt_titles == [] and rows[name].title_ko is None


def test_voice_cast_ties_and_limits(spark):
    cast = [{"id": i, "name": f"p{i}", "total_episode_count": c, "roles": r} for i, c, r in (
        (1, 5, [{"character": "A (voice)", "episode_count": 2}, {"character": "B", "episode_count": 2}]), (2, 9, [{"character": "C", "episode_count": 1}, {"character": "D (voice)", "episode_count": 8}]),
        (3, 5, []), (4, None, None), (2, 1, [{"character": "E", "episode_count": 1}]),
    )]
    shows = docs(spark, n.SHOW, [("s", {"aggregate_credits": {"cast": cast}}), ("t", {})])
    rows = {r.person: (r.character, r.episode_count) for r in n.voice_cast(shows, None).collect()}
    assert rows == {1: ("A", 5), 2: ("D", 9), 3: (None, 5), 4: (None, None)}
    assert {r.person for r in n.voice_cast(shows, 2).collect()} == {1, 2}


def test_bilingual_without_loss(spark):
    ko = docs(spark, n.SEASON, [("s", 1, {"episodes": [{"episode_number": 1, "name": "하나", "overview": " "}, {"episode_number": 2, "name": "둘", "air_date": "2020-01-05"}, {"episode_number": 2, "name": "둘째"}]}), ("s", 2, {})], "series_id string, season int")
    en = docs(spark, n.SEASON, [("s", 1, {"episodes": [{"episode_number": 2, "name": "two", "overview": "x"}, {"episode_number": 3, "name": "", "runtime": 5}]}), ("s", 3, "broken")], "series_id string, season int")
    rows = {(r.season, r.number): (r.title_ko, r.title_en, r.overview_ko, r.overview_en, r.airdate, r.runtime) for r in n.bilingual_episodes(ko, en).collect()}
    assert rows == {(1, 1): ("하나", None, None, None, None, None), (1, 2): ("둘째", "two", None, "x", None, None), (1, 3): (None, None, None, None, None, 5)}


def test_seasons_prefer_their_own_document(spark):
    shows = docs(spark, n.SHOW, [("s", {"seasons": [{"season_number": 0, "name": "Specials"}, {"season_number": 1, "name": "One", "air_date": "2020-01-01", "episode_count": 9}, {"season_number": 2, "name": "Two", "episode_count": 4}]})])
    bodies = docs(spark, n.SEASON, [("s", 1, {"name": "", "overview": "o", "episodes": [{"episode_number": 1}]})], "series_id string, season int")
    rows = {r.tmdb_season: (r.name_ko, r.overview_ko, r.air_date, r.episode_count) for r in n.seasons(shows, bodies).collect()}
    assert rows == {1: ("One", "o", dt.date(2020, 1, 1), 1), 2: ("Two", None, None, 4)}


def test_regular_episodes(spark):
    eps = [{"season": 2, "number": 1, "name": "c"}, {"season": 1, "number": 2, "name": "b", "type": "regular"}, {"season": 1, "number": None, "name": "x"}, {"season": 1, "number": 0, "name": "y"},
           {"season": 1, "number": 1, "name": "a", "summary": "<p>S</p>", "airdate": "2020-01-01"}, {"season": 1, "number": 3, "type": "insignificant_special", "name": "z"}]
    rows = [(r.place, r.title_en, r.summary_en) for r in n.regular_episodes(docs(spark, n.EPISODES, [("s", eps), ("t", [])])).orderBy("place").collect()]
    assert rows == [(0, "a", "S"), (1, "b", None), (2, "c", None)]


def test_main_role_is_never_lost(spark):
    edge = lambda role, about, pic: {"role": role, "node": {"id": 7, "name": {"full": f"n{pic}"}, "description": about, "image": {"large": pic}}}
    rows = [("s", i, f"e{i}", {"data": {"Media": {"characters": {"edges": [edge(*x)]}}}}) for i, x in enumerate([("MAIN", "first", "p0"), ("SUPPORTING", None, "p1")])]
    (r,) = n.characters(docs(spark, n.EDGES, [*rows, ("s", 5, "e5", {"data": None})], "series_id string, order_in_series int, entry_key string")).collect()
    assert (r.role, r.description, r.image_url, r.first_entry, r.name) == ("MAIN", "first", "p1", "e0", "np0")
