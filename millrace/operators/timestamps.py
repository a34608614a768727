"""Mixed timestamp formats and zones to one UTC instant (problem 6).

Every value is reduced to its shape: digits become ``9``, everything else stays. All values of
one shape have their fields at the same places, so a shape is matched against the formats once
(per Python worker, in a bounded cache) and its values are then cut and converted as arrays.
Wall times go through the zone transition tables of ``zones``.

Defined results: null, blank, placeholder, cut-off and impossible values give no row (or a null
instant from ``normalise``); a zone abbreviation that is not of the value's own feed is looked up
among all feeds, and gives no instant if it is unknown or ambiguous; a repository without a feed
is read as UTC with the order YMD; of several feeds of a repository one counts (see ``Feeds``). Extra columns, repeated
rows and empty tables are harmless: only the named columns are read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.zones import ZoneTable, zone_table

#: Month names by language; the key is the lower-case name without a dot.
MONTHS = {
    n: k + 1
    for names in (
        "january february march april may june july august september october november december",
        "jan feb mar apr may jun jul aug sep oct nov dec",
        "januar februar märz april mai juni juli august september oktober november dezember",
        "jan feb mär apr mai jun jul aug sep okt nov dez",
        "jan feb mrz apr mai juni juli aug sept okt nov dez",
        "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
        "ene feb mar abr may jun jul ago sept oct nov dic",
        "jan. feb. march april may june july aug. sept. oct. nov. dec.",
    )
    for k, n in enumerate(x.rstrip(".") for x in names.split())
}
DAYS = "monday tuesday wednesday thursday friday saturday sunday mon tue tues wed thu thur thurs fri sat sun montag dienstag mittwoch donnerstag freitag samstag sonntag mo di mi do fr sa so".split()

_MONTH = "(?P<mon>" + "|".join(sorted(MONTHS, key=len, reverse=True)) + r")\.?"
_DAY = "(?:(?:" + "|".join(sorted(DAYS, key=len, reverse=True)) + r")\.?,?\s+)?"
_AMPM = r"(?:\s*(?P<ap>am|pm|a\.m\.|p\.m\.))?"
_ZONE = r"(?:\s*(?:(?:gmt|utc)?(?P<sign>[+-])(?P<oh>\d\d):?(?P<om>\d\d)|(?P<abbr>z|[a-z]{2,5})|(?:gmt|utc)(?P<sign1>[+-])(?P<oh1>\d\d?)|(?P<sign2>[+-])(?P<oh2>\d\d)))?(?:\s*\[[\w/+-]+\]|\s*\([\w /+-]+\))?"
_FRACTION = r"(?:[.,](?P<f>\d{1,12}))?"
_CLOCK = rf"(?P<h>\d\d?):(?P<mi>\d\d)(?::(?P<s>\d\d){_FRACTION})?"
_BASIC = rf"(?P<h>\d\d)(?P<mi>\d\d)(?:(?P<s>\d\d){_FRACTION})?"
_TIME = rf"(?:(?:t|(?:\s*,)?\s+(?:at\s+|um\s+)?){_CLOCK}{_AMPM}(?:\s*uhr)?{_ZONE})?"

#: Formats by name, tried in this order; each must match the whole value.
FORMATS: list[tuple[str, re.Pattern]] = [
    (name, re.compile(p, re.IGNORECASE))
    for name, p in (
        ("iso", rf"(?P<y>\d{{4}})-(?P<mo>\d\d?)-(?P<d>\d\d?){_TIME}"),
        ("iso", rf"(?P<y>\d{{4}})(?P<sep>[/.])(?P<mo>\d\d?)(?P=sep)(?P<d>\d\d?){_TIME}"),
        ("week", rf"(?P<y>\d{{4}})-?W(?P<w>\d\d)-?(?P<wd>\d){_TIME}"),
        ("ordinal", rf"(?P<y>\d{{4}})-(?P<yd>\d{{3}}){_TIME}"),
        ("iso", rf"(?P<y>\d{{4}})(?P<mo>\d\d)(?P<d>\d\d)(?:[t\s]{_BASIC}{_ZONE})?"),
        ("epoch", r"(?P<e>\d{9,10})(?:[.,](?P<f>\d{1,12}))?"),
        ("epoch3", r"(?P<e>\d{12,13})(?:\.\d+)?"),
        ("epoch6", r"(?P<e>\d{15,16})"),
        ("epoch9", r"(?P<e>\d{18,19})"),
        ("numeric", rf"(?P<n1>\d\d?)(?P<sep>[/.-])(?P<n2>\d\d?)(?P=sep)(?P<n3>\d{{4}}|\d\d){_TIME}"),
        ("named", rf"{_DAY}(?P<d>\d\d?)(?:st|nd|rd|th)?[\s./-]*(?:de\s+)?{_MONTH}[\s,./-]+(?:de\s+)?(?P<y>\d{{4}}|\d\d){_TIME}"),
        ("named", rf"{_DAY}{_MONTH}[\s./-]*(?P<d>\d\d?)(?:st|nd|rd|th)?,?\s+(?P<y>\d{{4}}){_TIME}"),
        ("named", rf"(?P<y>\d{{4}})[\s./-]+{_MONTH}[\s./-]+(?P<d>\d\d?){_TIME}"),
        ("ctime", rf"{_DAY}{_MONTH}\s+(?P<d>\d\d?)\s+{_CLOCK}(?:\s+(?P<abbr>[a-z]{{2,5}}))?\s+(?P<y>\d{{4}})"),
    )
]
_CACHE_LIMIT, _CACHED_LENGTH = 50_000, 200
_plans: dict[str, tuple | None] = {}


def plan_of(shape: str) -> tuple | None:
    """The format of a shape of any length with the span of every field, or None; those of up to _CACHED_LENGTH
    characters are cached per worker."""
    if shape in _plans:
        return _plans[shape]
    plan = None
    for name, pattern in FORMATS:
        if m := pattern.fullmatch(shape):
            plan = name, {k: m.span(k) for k, v in m.groupdict().items() if v is not None}, {k: v.lower() for k, v in m.groupdict().items() if v and not v[0].isdigit()}
            break
    if len(shape) <= _CACHED_LENGTH:
        if len(_plans) >= _CACHE_LIMIT:
            _plans.clear()
        _plans[shape] = plan
    return plan


def _days(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Days since 1970-01-01 of proleptic Gregorian dates."""
    months = (y.astype(np.int64) - 1970) * 12 + (m - 1)
    return months.astype("datetime64[M]").astype("datetime64[D]").astype(np.int64) + d - 1


def _month_len(y: np.ndarray, m: np.ndarray) -> np.ndarray:
    return _days(y + (m == 12), m % 12 + 1, np.ones_like(m)) - _days(y, m, np.ones_like(m))


_FEED = ("zone", "std_abbrev", "dst_abbrev", "date_order")


class Abbreviations:
    """What all feeds have in common: the tables of their zones, and the offsets of the abbreviations that mean the same in
    each. Of a row for each (zone, name, whether of summer time) in use."""

    def __init__(self, uses: list[tuple[str | None, str | None, bool]]) -> None:
        self.tables: dict[str, ZoneTable] = {z: zone_table(z) for z in sorted({z for z, _, _ in uses if z})}
        anywhere: dict[str, set[int]] = {}
        for zone, name, summer in uses:
            if zone and name:
                t = self.tables[zone]
                anywhere.setdefault(name.lower(), set()).add(t.summer if summer else t.standard)
        self.any = {k: next(iter(v)) for k, v in anywhere.items() if len(v) == 1}


class Feeds:
    """Zone, abbreviations and order of all-numeric dates per repository (a bounded table).

    Of several feeds of a repository the greatest counts, by the columns of ``_FEED`` in turn with null as the least. ``among``
    are the abbreviations of all feeds, where ``rows`` are some of them.
    """

    def __init__(self, rows: list, among: Abbreviations | None = None) -> None:
        rows = [r for r in rows if r["repository"] is not None]
        among = among or Abbreviations([(r["zone"], r[f"{k}_abbrev"], k == "dst") for r in rows for k in ("std", "dst")])
        one: dict[str, dict] = {}
        for r in rows:
            one[r["repository"]] = max(one.get(r["repository"], r), r, key=lambda x: [(x[k] is not None, x[k] or "") for k in _FEED])
        self.zone: dict[str, ZoneTable] = {k: among.tables[r["zone"]] for k, r in one.items() if r["zone"]}
        self.order = {k: (r["date_order"] or "YMD").upper() for k, r in one.items()}
        self.own: dict[tuple[str, str], int] = {}
        for k, t in self.zone.items():
            for name, off in ((one[k]["dst_abbrev"], t.summer), (one[k]["std_abbrev"], t.standard)):
                if name:
                    self.own[k, name.lower()] = off
        self.any = among.any

    def abbreviation(self, repository: str | None, name: str) -> int | None:
        if name in ("z", "gmt", "utc", "ut"):
            return 0
        own = self.own.get((repository, name))
        return self.any.get(name) if own is None else own

    def same(self, repository: str) -> tuple:
        t = self.zone.get(repository)
        return t.zone if t else "", self.order.get(repository, "YMD")


_PLAIN_UTC = ZoneTable("UTC", "", np.array([], np.int64), np.array([0], np.int64), 0, 0)


def _convert(values: np.ndarray, plan: tuple, repository: str | None, feeds: Feeds) -> tuple[np.ndarray, np.ndarray]:
    """Microseconds since 1970 in UTC of values of one shape and repository, and which of them exist."""
    name, spans, words = plan
    n = len(values)
    chars = values.astype(f"U{len(values[0])}").view(np.uint32).reshape(n, -1).astype(np.int64) - 48

    def num(key: str, default: int = 0) -> np.ndarray:
        if key not in spans:
            return np.full(n, default, np.int64)
        a, b = spans[key]
        out = np.zeros(n, np.int64)
        for k in range(a, b):
            out = out * 10 + chars[:, k]
        return out

    def micros() -> np.ndarray:
        if "f" not in spans:
            return np.zeros(n, np.int64)
        a, b = spans["f"]
        out = np.zeros(n, np.int64)
        for k in range(a, a + 6):
            out = out * 10 + (chars[:, k] if k < b else 0)
        return out

    ok = np.ones(n, bool)
    if name.startswith("epoch"):
        unit = int(name[5:] or 0)
        e = num("e")
        us = e * 10 ** (6 - unit) if unit <= 6 else e // 10 ** (unit - 6)
        return us + (micros() if unit == 0 else 0), ok
    if name == "numeric":
        a, b, c = num("n1"), num("n2"), num("n3")
        order = feeds.order.get(repository, "YMD")
        short = spans["n3"][1] - spans["n3"][0] == 2
        if order == "YMD" and short and spans["n1"][1] - spans["n1"][0] == 2:
            y, m, d = a + 2000, b, c
        else:
            y = c + 2000 if short else c
            m, d = (a, b) if order == "MDY" else (b, a)
    else:
        y = num("y")
        if spans["y"][1] - spans["y"][0] == 2:
            y = y + 2000
        m = np.full(n, MONTHS[words["mon"]], np.int64) if "mon" in words else num("mo", 1)
        d = num("d", 1)
    ok &= (y >= 1) & (m >= 1) & (m <= 12) & (d >= 1)
    m = np.clip(m, 1, 12)
    ok &= d <= _month_len(y, m)
    day = _days(y, m, d)
    if name == "week":
        w, wd = num("w"), num("wd")
        first = lambda yy: (lambda j4: j4 - (j4 + 3) % 7)(_days(yy, np.ones_like(yy), np.full_like(yy, 4)))
        start = first(y)
        ok &= (w >= 1) & (wd >= 1) & (wd <= 7) & (w <= (first(y + 1) - start) // 7)
        day = start + (w - 1) * 7 + wd - 1
    elif name == "ordinal":
        yd = num("yd")
        jan = _days(y, np.ones_like(y), np.ones_like(y))
        ok &= (yd >= 1) & (yd <= _days(y + 1, np.ones_like(y), np.ones_like(y)) - jan)
        day = jan + yd - 1
    h, mi, s = num("h"), num("mi"), num("s")
    if ap := words.get("ap"):
        ok &= (h >= 1) & (h <= 12)
        h = h % 12 + (12 if ap[0] == "p" else 0)
    f = micros()
    ok &= (mi <= 59) & (s <= 60) & ((h <= 23) | ((h == 24) & (mi == 0) & (s == 0) & (f == 0)))
    wall = day * 86400 + h * 3600 + mi * 60 + s
    k = next((k for k in ("", "1", "2") if f"sign{k}" in words), None)
    if k is not None:
        oh, om = num(f"oh{k}"), num("om") if not k else np.zeros(n, np.int64)
        ok &= (oh <= 23) & (om <= 59)
        sec = wall - (1 if words[f"sign{k}"] == "+" else -1) * (oh * 3600 + om * 60)
    elif "abbr" in words:
        off = feeds.abbreviation(repository, words["abbr"])
        if off is None:
            return wall, np.zeros(n, bool)
        sec = wall - off
    else:
        sec = feeds.zone.get(repository, _PLAIN_UTC).to_utc(wall)
    return sec * 1_000_000 + f, ok


def _render(us: np.ndarray) -> np.ndarray:
    text = np.datetime_as_string(us.astype("datetime64[us]"), unit="us")
    return np.char.add(text, "Z").astype(object)


def normalise_batch(values: pd.Series, repositories: pd.Series, feeds: Feeds) -> pd.Series:
    """UTC text of each value, or None."""
    out = np.full(len(values), None, object)
    v = values.to_numpy(object)
    live = np.flatnonzero(~pd.isna(v))
    if not len(live):
        return pd.Series(out, index=values.index)
    text = np.array([x.strip() for x in v[live]], object)
    shapes = pd.Series(text).str.translate({k: "9" for k in range(48, 58)})
    repo, known = pd.factorize(repositories.to_numpy(object)[live])  # -1: null, which is no feed's
    groups = pd.DataFrame({"shape": shapes.to_numpy(object), "repo": repo}).groupby(["shape", "repo"], sort=False).indices
    for (shape, r), at in groups.items():
        if plan := plan_of(shape):
            us, ok = _convert(text[at], plan, known[r] if r >= 0 else None, feeds)
            ok &= (us > -62135596800 * 10**6) & (us < 253402300800 * 10**6)
            out[live[at[ok]]] = _render(us[ok])
    return pd.Series(out, index=values.index)


#: Up to so many feeds are broadcast for their join to the rows; of more Spark chooses the kind of join.
SENT_FEEDS = 100_000


def load_feeds(feeds: DataFrame) -> Feeds:
    """The feeds as a driver-side table, for callers that know their number to be small."""
    return Feeds([r.asDict() for r in feeds.select("repository", *_FEED).collect()])


def normalise(feeds: Feeds) -> callable:
    """A column function ``f(value, repository)`` giving the UTC text."""

    @F.pandas_udf("string")
    def to_utc(value: pd.Series, repository: pd.Series) -> pd.Series:
        return normalise_batch(value, repository, feeds)

    return lambda value, repository: to_utc(value, repository)


def _among(feeds: DataFrame) -> Abbreviations:
    """Of any number of feeds: as many rows as there are zones with names that a value can have (up to five letters, of
    which lower case makes ten characters at most)."""
    uses = [F.struct(F.col(f"{k}_abbrev").alias("name"), F.lit(k == "dst").alias("summer")) for k in ("std", "dst")]
    rows = feeds.select("zone", F.explode(F.array(*uses)).alias("use"))
    name = F.when(F.length("use.name").between(2, 10), F.col("use.name"))
    return Abbreviations([tuple(r) for r in rows.select("zone", name, "use.summer").distinct().collect()])


def found_instants(tables: dict[str, DataFrame], feeds: DataFrame, fields: tuple[str, ...] = ("created", "updated"), sent: int = SENT_FEEDS) -> DataFrame:
    """One row per value that names an instant: rec, crawl_seq, field, utc. One scan per table; each row gets the feed of its
    repository by a join, without a shuffle of the rows for up to ``sent`` feeds. The number of feeds, the batches and their
    order have no part in the results: zones and abbreviations are always those of all feeds."""
    feeds = feeds.select(*[F.col(c).cast("string").alias(c) for c in ("repository", *_FEED)]).filter("repository IS NOT NULL")
    among = _among(feeds)
    own = feeds.groupBy("repository").agg(F.to_json(F.max(F.struct(*_FEED))).alias("feed"))
    if feeds.count() <= sent:
        own = F.broadcast(own)

    def convert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            held = Feeds([dict.fromkeys(_FEED) | json.loads(x) | {"repository": x} for x in b["feed"].dropna().unique()], among)
            for field in fields:
                utc = normalise_batch(b[field], b["feed"], held)
                keep = utc.notna()
                if keep.any():
                    yield pd.DataFrame({"rec": b["rec"][keep], "crawl_seq": b["crawl_seq"][keep], "field": field, "utc": utc[keep]})

    out: DataFrame | None = None
    for rec, df in tables.items():
        src = df.select(F.lit(rec).alias("rec"), "crawl_seq", F.col("repository").cast("string").alias("repository"), *[F.col(f).cast("string") for f in fields])
        part = src.join(own, "repository", "left").drop("repository").mapInPandas(convert, "rec string, crawl_seq bigint, field string, utc string")
        out = part if out is None else out.unionByName(part)
    return out


def parse_column(value: Column, repository: Column, feeds: DataFrame) -> Column:
    """The UTC text of one column, for use in a projection."""
    return normalise(load_feeds(feeds))(value, repository)
