import json

from graphloom.sources.payloads import project_api_payload

PAGES = [
    ("hn_algolia", {"hits": [{"objectID": "7", "title": "T", "url": "http://t", "created_at": "2024-01-01T00:00:00Z", "author": "me"}, {"objectID": "8", "story_title": "S", "url": "http://s", "story_text": "body"}, {"objectID": "9", "title": "self"}, {"objectID": "10", "url": "http://x"}]}),
    ("reddit", {"data": {"children": [{"data": {"title": "T", "permalink": "/r/a/1", "created_utc": 1704067200.5, "selftext": "", "author": "u", "subreddit": "a", "url": "http://o", "id": "1"}}, {"data": {"title": "", "permalink": "/x"}}]}}),
    ("devto", [{"url": "http://d", "title": "D", "description": "about", "published_at": "2024", "user": {"username": "w"}, "id": 5, "tags": "a,b", "positive_reactions_count": 3}, {"title": "no url"}]),
    ("github_releases", [{"html_url": "http://r", "name": "", "tag_name": "v1", "body": "notes", "author": {"login": "a"}, "draft": False, "id": 1}, {"tag_name": "v2"}]),
    ("npm_trending", {"objects": [{"package": {"name": "p", "version": "1.0", "keywords": ["k"], "publisher": {"username": "n"}}, "score": {"final": 0.5}}, {"score": {}}]}),
    ("github_trending", {"items": [{"full_name": "o/r", "stargazers_count": 5, "topics": ["x", "y"], "description": "d", "language": "Go", "created_at": "2023"}, {"html_url": "http://z"}]}),
    ("oss_insight", {"data": {"rows": [{"repo_name": "o/r", "stars": 2, "pushed_at": "2024-02-02"}]}}),
    ("oss_insight", {"rows": [{"repo_name": "a/b"}]}),
    ("ecosystems_timeline", [{"url": "http://e", "title": "E", "body": "B", "event_type": "push", "repository": {"full_name": "o/r"}, "id": 4}]),
    ("twitter_search", {"items": [{"id": "1", "text": "x" * 120, "author_username": "a"}, {"id": "2"}, {"text": "no id"}]}),
    ("telegraph", {}), ("devto", {"not": "a list"}),
]


def test_one_fixture_for_each_kind(spark):
    rows = [(i, kind, json.dumps(body)) for i, (kind, body) in enumerate(PAGES)] + [(90, "devto", "not json"), (91, "devto", None)]
    items, rejects = project_api_payload(spark.createDataFrame(rows, "page int, kind string, body string"))
    got = {(r.page, r.position): r for r in items.collect()}
    brief = {k: (r.source_uri, r.title, r.text, r.published_at, r.author) for k, r in got.items()}
    assert brief == {
        (0, 0): ("https://news.ycombinator.com/item?id=7", "T", "T", "2024-01-01T00:00:00Z", "me"), (0, 1): ("https://news.ycombinator.com/item?id=8", "S", "body", None, None),
        (1, 0): ("https://www.reddit.com/r/a/1", "T", "T", "2024-01-01T00:00:00.500Z", "u"), (2, 0): ("http://d", "D", "about", "2024", "w"), (3, 0): ("http://r", "v1", "notes", None, "a"),
        (4, 0): ("https://www.npmjs.com/package/p", "p", "p", None, "n"),
        (5, 0): ("https://github.com/o/r", "o/r (5 stars)", "Repository: o/r\nDescription: d\nStars: 5 | Forks: 0\nLanguage: Go\nTopics: x, y", "2023", None),
        (6, 0): ("https://github.com/o/r", "o/r (2 stars)", "Repository: o/r\nStars: 2 | Forks: 0\nLast push: 2024-02-02", "2024-02-02", None), (7, 0): ("https://github.com/a/b", "a/b (0 stars)", "Repository: a/b\nStars: 0 | Forks: 0", None, None),
        (8, 0): ("http://e", "E", "B", None, None), (9, 0): ("https://x.com/i/status/1", "x" * 97 + "...", "x" * 120, None, "a"),
    }
    assert got[2, 0].metadata == {"devto_id": "5", "tags": "a,b", "reactions": "3"} and got[3, 0].metadata["draft"] == "false" and got[4, 0].metadata["score"] == "0.5" and json.loads(got[4, 0].metadata["keywords"]) == ["k"]
    assert {(r.page, r.position, r.reason) for r in rejects.collect()} == {
        (0, 2, "no_link"), (0, 3, "no_title"), (1, 1, "no_title"), (2, 1, "no_link"), (3, 1, "no_link"), (4, 1, "no_title"), (5, 1, "no_title"), (9, 1, "no_title"), (9, 2, "no_link"), (10, None, "unknown_kind"), (11, None, "no_list"), (90, None, "no_list"), (91, None, "no_list"),
    }
    first, _ = project_api_payload(spark.createDataFrame(rows, "page int, kind string, body string"), 1)
    assert first.filter("page = 0").count() == 1
