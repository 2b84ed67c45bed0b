"""Search pages, hashtags and browser seeds: good, odd and foreign payloads side by side."""

import json

from pyspark.sql import functions as F

from tidemark.sources import seeds as D

WATCH, REEL = "https://www.youtube.com/watch?v=abc", "https://instagram.com/reel/xyz/"


def post(uri="at://1", did="did:1", text="", at="2026-09-25T07:00:00Z", **over):
    return {"uri": uri, "author": {"did": did}, "record": {"text": text, "createdAt": at} | over}


def test_search_posts(spark):
    facets = [{"features": [{"uri": REEL}, {"tag": "x"}]}, {"features": None}]
    posts = [
        post(text=f"Solana clip {WATCH} by me@mail.com", facets=facets, embed={"external": {"uri": "https://example.org/a"}}), post(uri="", text="no id"), post(did=None), post(uri="at://old", at="2026-09-25T01:00:00Z"),
        {"uri": "at://2", "author": {"did": "d"}, "indexedAt": "2026-09-25T07:20:00Z", "record": None, "embed": {"external": {"uri": WATCH}}},
    ]
    pages = [json.dumps({"posts": posts}), json.dumps({"posts": {}}), "broken", None, json.dumps({"posts": []}), json.dumps({"posts": [post(uri=f"at://n{i}") for i in range(40)]})]
    df = spark.createDataFrame(list(enumerate(pages)), "page int, body string").withColumn("observed_at", F.lit("2026-09-25 07:30:00").cast("timestamp"))
    got = D.search_posts(df).orderBy("page", "post_id").collect()
    assert [(r.page, r.error) for r in got if r.error] == [(1, "malformed_search_page"), (2, "malformed_search_page"), (3, "malformed_search_page")]
    first = [r for r in got if r.page == 0]
    assert [(r.post_id, r.links, r.has_object) for r in first] == [("at://1", ["instagram.com/reel/xyz", "youtube.com/video/abc"], True), ("at://2", ["youtube.com/video/abc"], True)]
    assert first[0].tokens[0] == "solana" and "me@mail.com" not in first[0].excerpt and first[1].excerpt == ""
    assert sum(r.page == 5 for r in got) == 35 and not any(r.page == 4 for r in got)


def test_hashtags_and_seeds(spark):
    api = {"data": {"list": [{"hashtag_name": "#Fun Dance", "video_count": 3, "view_count": 9, "rank": 1, "category": "c"}, {"hashtag_name": " # "}, {}]}}
    seed = {"schema": D.SEED_SCHEMA, "generated_at": "2026-09-25T07:11:12Z", "hashtags": [{"name": "Abc", "category": "Pets", "views": 5}, {"name": ""}], "videos": [{"url": "https://www.tiktok.com/@a/video/7", "video_id": 7, "text": "viral video"}, {"url": "", "video_id": 8}, {"url": "x"}]}
    bodies = [json.dumps(api), json.dumps(seed), json.dumps(seed | {"schema": "v1"}), "broken", None, json.dumps({"data": {"hashtags": []}})]
    df = spark.createDataFrame(list(enumerate(bodies)), "i int, body string")
    got = D.hashtags(df).orderBy("i").collect()
    assert [(r.i, r.post_id, r.url, r.error) for r in got] == [(0, "hashtag:fun dance", "https://www.tiktok.com/tag/Fun%20Dance", None), *[(i, None, None, "malformed_list") for i in (1, 2, 3, 4)]]
    assert got[0].text == "#Fun Dance TikTok Creative Center trend videos=3 views=9 trend=0" and (got[0].rank, got[0].category) == (1, "c")
    got = D.hashtags(df, browser=True).orderBy("i").collect()
    assert [(r.i, r.post_id, r.text, r.views, r.error) for r in got if r.i in (1, 2)] == [(1, "hashtag:abc:2026-09-25T07", "#Abc Pets", 5, None), (2, None, None, None, "unexpected_schema")]
    assert [r.error for r in got if r.i not in (1, 2)] == ["unexpected_schema"] * 4
    got = D.seed_videos(df, browser=True).where("error IS NULL").collect()
    assert [(r.post_id, r.links, r.buckets) for r in got] == [("video:7", ["https://www.tiktok.com/@a/video/7"], ["origin_tiktok", "viral", "direct_video_seed"])]
    videos = {"data": {"videos": [{"item_url": "https://www.tiktok.com/@a/video/9", "title": "t", "author": "a", "cover": "m"}, {"url": "https://other.org/x", "id": "1"}, {"id": "2"}]}}
    got = D.seed_videos(spark.createDataFrame([(json.dumps(videos),), ("{}",)], "body string")).collect()
    assert [(r.post_id, r.actor_id, r.media_url, r.error) for r in got] == [("https://www.tiktok.com/@a/video/9", "a", "m", None), (None, None, None, "malformed_list")]
