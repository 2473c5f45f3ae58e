import datetime
import random

from factloom.llm import url_filters

DAY = lambda n: datetime.date(2024, 1, 1) + datetime.timedelta(n)
ENTRIES = "list_name string, key string, action string, entry_date date"
CAPTURES = "page_id long, url string, fetched date, lists string, key string"
#: Each url with the keys that an entry may name.
URLS = {
    "http://a.b.com/x/y": {"a.b.com", "b.com", "a.b.com/x"}, "https://U@B.com:80": {"b.com"}, "http://a.b.com./x?q": {"a.b.com", "b.com", "a.b.com/x"},
    "ftp://c.org/": {"c.org"}, "localhost": set(), "": set(), None: set(), "http://" + "s." * 300 + "c.org/" + "p" * 5000: None,
}


def verdicts(spark, captures, entries):
    listed = url_filters.intervals(spark.createDataFrame(entries, ENTRIES))
    rows = url_filters.evaluate(spark.createDataFrame([(*c, "mine", "mine") for c in captures], CAPTURES), listed)
    assert rows.columns == ["page_id", "url", "fetched", "lists", "blocked"]
    return sorted((str(r.page_id), str(r.url), str(r.fetched), r.lists, r.blocked) for r in rows.collect())


def test_captures_equal_a_replay_of_the_entries(spark):
    rng = random.Random(6)
    keys = ["a.b.com", "b.com", "a.b.com/x", "c.org", "com"]
    entries = [(rng.choice("lm"), rng.choice(keys), rng.choice(["add", "add", "remove"]), DAY(rng.randint(0, 20))) for _ in range(60)]
    entries += entries[:5] + [(None, "b.com", "add", DAY(0)), ("l", None, "add", DAY(0)), ("l", "b.com", None, DAY(0)), ("l", "b.com", "add", None)]
    captures = [(rng.choice([None, *range(9)]), rng.choice(list(URLS)), rng.choice([None, *map(DAY, range(-1, 23))])) for _ in range(200)]
    captures += captures[:10]

    def active(name, key, day):
        said = [e for e in entries if e[0] == name and e[1] == key and e[2] and e[3] and e[3] <= day]
        last = [a for _, _, a, d in said if d == max(e[3] for e in said)]
        return bool(last) and "remove" not in last

    want = []
    for i, url, day in captures:
        own = {"c.org"} if URLS[url] is None else URLS[url]
        names = sorted(n for n in "lm" if day and any(active(n, k, day) for k in own))
        want.append((str(i), str(url), str(day), ",".join(names), bool(names)))
    assert verdicts(spark, captures, entries) == sorted(want)


def test_empty_tables(spark):
    assert verdicts(spark, [], [("l", "b.com", "add", DAY(0))]) == []
    assert verdicts(spark, [(1, "http://b.com", DAY(0))], []) == [("1", "http://b.com", "2024-01-01", "", False)]
