"""The bars source: which predicates it takes, the pages they leave, and what a stream reads again after a restart."""

from datetime import datetime, timedelta

from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, In, LessThan, LessThanOrEqual, StringContains

from tidegauge.sources import service as S

START = datetime(2024, 1, 1)
HOUR = timedelta(hours=1)
NOW = [START]


def clock():
    return NOW[0]


def serve(kind, symbol, timeframe, start, stop):
    """A bar an hour, and one more on each side than was asked for."""
    first = START + ((start - START) // HOUR - 1) * HOUR
    return [(first + i * HOUR, 1.0, 2.0, 0.5, 1.5, float(i)) for i in range((stop - first) // HOUR + 2)]


def options(**more):
    return {"kind": "rows", "symbols": "a,b,c", "timeframe": "H1", "start": START.isoformat(), "end": (START + 99 * HOUR).isoformat(), "fetcher": f"{__name__}.serve", "page": "20", "pause": "0"} | more


def spans(reader):
    return [(p.symbol, (p.start - START) / HOUR, (p.stop - START) / HOUR) for p in reader.partitions()]


def test_predicates_leave_out_pages():
    whole = S.PushedReader(options())
    assert list(whole.pushFilters([])) == [] and len(spans(whole)) == 15
    r = S.PushedReader(options())
    other = [EqualTo(("close",), 1.5), StringContains(("symbol",), "a"), GreaterThan(("volume",), 2.0)]
    left = list(r.pushFilters([In(("symbol",), ("a", "c", "z")), GreaterThan(("ts",), START + 30 * HOUR), LessThanOrEqual(("ts",), START + 55 * HOUR), *other]))
    assert left == other
    got = spans(r)
    assert {s for s, *_ in got} == {"a", "c"} and len(got) == 4 and min(a for _, a, _ in got) > 30 and max(b for *_, b in got) == 55
    rows = [row for p in r.partitions() for row in r.read(p)]
    assert sorted({row[2] for row in rows}) == [START + h * HOUR for h in range(31, 56)] and len(rows) == 50
    one = S.PushedReader(options())
    assert list(one.pushFilters([EqualTo(("symbol",), "b"), EqualTo(("ts",), START + 7 * HOUR), EqualTo(("timeframe",), "H1")])) == []
    assert [row[:3] for p in one.partitions() for row in one.read(p)] == [("b", "H1", START + 7 * HOUR)]


def test_predicates_that_nothing_meets_make_no_call():
    for asked in ([EqualTo(("symbol",), "z")], [EqualTo(("timeframe",), "D")], [LessThan(("ts",), START)], [GreaterThanOrEqual(("ts",), START + 500 * HOUR)], [GreaterThan(("ts",), START + 9 * HOUR), LessThan(("ts",), START + 9 * HOUR)]):
        r = S.PushedReader(options(fetcher="nowhere.at_all"))
        assert list(r.pushFilters(asked)) == [] and [row for p in r.partitions() for row in r.read(p)] == []


def test_payloads_keep_predicates_of_time():
    r = S.PushedReader(options(kind="klines"))
    of_time = GreaterThan(("ts",), START + 30 * HOUR)
    assert list(r.pushFilters([of_time, EqualTo(("symbol",), "a")])) == [of_time] and r.symbols == ["a"]


def test_a_stream_goes_on_without_loss_or_repeat():
    opts = options(clock=f"{__name__}.clock", most="24")
    del opts["end"]
    reader, seen, at = S.BarsStreamReader(opts), [], None
    at = reader.initialOffset()
    for hours in (10.5, 10.5, 60, 200):
        NOW[0] = START + hours * HOUR
        if hours == 60:  # a restart: a new reader knows offsets only
            reader = S.BarsStreamReader(opts)
        end = reader.latestOffset()
        seen += [row[:3] for p in reader.partitions(at, end) for row in reader.read(p)]
        reader.commit(end)
        at = end
    until = (datetime.fromisoformat(at["until"]) - START) // HOUR
    assert until == 60 + 24  # the last batch is bounded, the one after the restart isn't yet
    assert sorted(seen) == [(s, "H1", START + h * HOUR) for s in "abc" for h in range(until)]


def test_bars_that_are_late_are_read_again():
    opts = options(clock=f"{__name__}.clock", again="3")
    NOW[0] = START + 10 * HOUR
    reader = S.BarsStreamReader(opts)
    first = reader.latestOffset()
    NOW[0] = START + 12 * HOUR
    hours = sorted({(row[2] - START) // HOUR for p in reader.partitions(first, reader.latestOffset()) for row in reader.read(p)})
    assert hours == [7, 8, 9, 10, 11] and reader.partitions(first, first) == []
