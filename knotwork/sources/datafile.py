"""Checksummed text data files and the tables that are parsed from them.

A file has four header lines (name, title, notice, line count and checksum), data lines of at most 79 characters in
ISO-8859-1, and a trailer. The files are small and ordered, so the driver reads and checks them; tables are DataFrames.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..core.graph import EARLY_DATA_FAULT, LATE_DATA_FAULT, SYNTAX_ERROR, PanicError

# Fixed value: the 96 characters of the files in the order of their codes.
ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_^~&@,;.:?!%#$+-*/|\\<=>()[]{}`'\" \n"
PRIME = (1 << 30) - 83
MONTHS = {"A": -26, "S": 5, "O": 35, "N": 66, "D": 96, "J": 127}  # day of the season before the first of a month


def code_of(ch: str) -> int:
    """Code of a character, 127 if it isn't of the alphabet."""
    return ALPHABET.find(ch) if ch in ALPHABET else 127


def char_of(code: int) -> str:
    return ALPHABET[code] if 0 <= code < len(ALPHABET) else ""


def checksum(lines: list[str], start: int = 0) -> int:
    """Fold of the codes of all characters and line ends: a = 2 a + code modulo a prime; other characters don't count."""
    a = start
    for line in lines:
        for ch in line + "\n":
            if ch in ALPHABET:
                a = (2 * a + ALPHABET.index(ch)) % PRIME
    return a


def number(text: str, base: int = 10) -> int:
    """Digits at the start of text in a base up to 36; none count as 0."""
    out = 0
    for ch in text:
        d = code_of(ch)
        if d >= base:
            break
        out = out * base + d
    return out


def locate(name: str, *folders: str) -> Path:
    for f in (".", *folders):
        if (p := Path(f) / name).is_file():
            return p
    raise PanicError(EARLY_DATA_FAULT, name)


def read_lines(path: str | Path) -> list[str]:
    """Data lines of a file whose header, trailer, line count and checksum hold; else panic 10 (header) or 11 (the rest)."""
    path = Path(path)
    try:
        lines = [x.rstrip(" ") for x in path.read_text(encoding="iso-8859-1").split("\n")]
    except OSError as e:
        raise PanicError(EARLY_DATA_FAULT, str(e)) from e
    if lines and lines[-1] == "":
        lines.pop()
    m = re.fullmatch(r"\* \(Checksum parameters (\d+),(\d+)\)", lines[3]) if len(lines) > 4 else None
    if not m or not lines[0].startswith(f'* File "{path.name}"') or not all(x.startswith("*") for x in lines[1:3]):
        raise PanicError(EARLY_DATA_FAULT, path.name)
    data = lines[4:-1]
    if lines[-1] != f'* End of file "{path.name}"' or len(data) != int(m[1]) or checksum(data) != int(m[2]):
        raise PanicError(LATE_DATA_FAULT, path.name)
    return data


def write_lines(path: str | Path, title: str, data: list[str]) -> None:
    """A file that read_lines takes."""
    name = Path(path).name
    text = [f'* File "{name}"', f"* {title}", "*", f"* (Checksum parameters {len(data)},{checksum(data)})", *data, f'* End of file "{name}"']
    Path(path).write_text("\n".join(text) + "\n", encoding="iso-8859-1")


def book_tables(spark: SparkSession, path: str | Path) -> tuple[DataFrame, DataFrame]:
    """characters(pos, code, name, descr) and scenes(chapter, label, scene, code) of a book file; a label & goes on with the chapter before, and so do its scenes' numbers."""
    lines = read_lines(path)
    gap = lines.index("")
    cast = []
    for k, x in enumerate(lines[:gap]):
        name, _, descr = x[3:].partition(", ")
        cast.append((k, x[:2], name, descr))
    scenes, chapter, label, scene = [], 0, "", 0
    for x in lines[gap + 1 :]:
        head, _, rest = x.partition(":")
        if not head.startswith("&"):
            chapter, label, scene = chapter + 1, head, 0
        for s in rest.split(";") if rest else []:
            scenes += [(chapter, label, scene, c) for c in s.split(",") if c]
            scene += 1
    return spark.createDataFrame(cast, "pos int, code string, name string, descr string"), spark.createDataFrame(scenes, "chapter int, label string, scene int, code string")


def econ_tables(spark: SparkSession, path: str | Path) -> tuple[DataFrame, DataFrame]:
    """sectors(node, title, sic, parent) of a preorder tree whose leaves have codes, and flows(src, dst, flow) between leaves by code and column."""
    lines = read_lines(path)
    gap = lines.index("")
    nodes, open_ = [], []
    for k, x in enumerate(lines[:gap]):
        title, _, sic = x.rpartition(":")
        parent = None
        while open_ and open_[-1][1] == 2:
            open_.pop()
        if open_:
            parent = open_[-1][0]
            open_[-1][1] += 1
        nodes.append((k, title, int(sic) if sic else None, parent))
        if not sic:
            open_.append([k, 0])
    flows, group = [], []
    for x in [*lines[gap + 1 :], ""]:
        if x == "":
            if group:
                src = len({f[0] for f in flows}) + 1
                cells = [number(v) for y in group for v in (y + "," * (10 - 1 - y.count(","))).split(",")[:10]]
                flows += [(src, j + 1, v) for j, v in enumerate(cells)]
            group = []
        else:
            group.append(x)
    return spark.createDataFrame(nodes, "node int, title string, sic int, parent int"), spark.createDataFrame([f for f in flows if f[2]], "src int, dst int, flow long")


def day_of(date: str) -> int:
    """Day of the season of a date line such as A26: a month's letter and a day; A31 is 5 days after A26."""
    return MONTHS[date[0]] + int(date[1:])


def games_tables(spark: SparkSession, path: str | Path) -> tuple[DataFrame, DataFrame]:
    """teams(pos, abbr, name, nick, conf, ap0, upi0, ap1, upi1) and games(day, team_a, score_a, venue, team_b, score_b); venue 1: at team_b's, 2: neutral."""
    teams, games, day = [], [], 0
    for x in read_lines(path):
        if m := re.fullmatch(r"(\S+) ([^(]*)\(([^)]*)\)([^;]*);(\d*),(\d*);(\d*),(\d*)", x):
            teams.append((len(teams), m[1], m[2], m[3], m[4], *(number(v) for v in m.groups()[4:])))
        elif x.startswith(">"):
            day = day_of(x[1:])
        elif m := re.fullmatch(r"([^\d;(]+)(\d+)([@,])([^\d;(]+)(\d+)", x):
            games.append((day, m[1], int(m[2]), 1 if m[3] == "@" else 2, m[4], int(m[5])))
        else:
            raise PanicError(SYNTAX_ERROR, x)
    return spark.createDataFrame(teams, "pos int, abbr string, name string, nick string, conf string, ap0 int, upi0 int, ap1 int, upi1 int"), spark.createDataFrame(games, "day int, team_a string, score_a int, venue int, team_b string, score_b int")


def words_table(spark: SparkSession, path: str | Path) -> DataFrame:
    """words(pos, word, cls, counts): five letters, a class *, + or blank, up to seven counts."""
    rows = [(k, x[:5], (x[5:6] or " "), [number(v) for v in x[6:].split(",")] if len(x) > 6 else []) for k, x in enumerate(read_lines(path))]
    return spark.createDataFrame(rows, "pos int, word string, cls string, counts array<long>")


def roget_tables(spark: SparkSession, path: str | Path) -> tuple[DataFrame, DataFrame]:
    """cats(cat, name) and refs(src, dst); a line that ends in a backslash goes on in the next."""
    cats, refs, held = [], [], ""
    for x in read_lines(path):
        held += x
        if held.endswith("\\"):
            held = held[:-1]
            continue
        m = re.fullmatch(r"(\d+)([^:]*):(.*)", held)
        if not m:
            raise PanicError(SYNTAX_ERROR, held)
        cats.append((int(m[1]), m[2].strip()))
        refs += [(int(m[1]), int(v)) for v in m[3].split()]
        held = ""
    return spark.createDataFrame(cats, "cat int, name string"), spark.createDataFrame(refs, "src int, dst int")


def miles_tables(spark: SparkSession, path: str | Path) -> tuple[DataFrame, DataFrame]:
    """cities(idx, name, lat, lon, pop) and dist(i, j, miles); each city's line is followed by its distances to the cities before it, last first."""
    cities, dist, left = [], [], 0
    for x in read_lines(path):
        if m := re.fullmatch(r"(.*)\[(\d+),(\d+)\](\d+)", x):
            cities.append((len(cities), m[1], int(m[2]), int(m[3]), int(m[4])))
            left = len(cities) - 1
        else:
            for v in x.split():
                left -= 1
                dist.append((len(cities) - 1, left, int(v)))
    return spark.createDataFrame(cities, "idx int, name string, lat int, lon int, pop int"), spark.createDataFrame(dist, "i int, j int, miles int")


def picture_table(spark: SparkSession, path: str | Path, width: int = 250) -> DataFrame:
    """pixels(row, col, grey): in a row, five base-85 digits hold four pixels, and three hold the last two of a width that isn't a multiple of 4; a row may take several lines."""
    digits = [code_of(ch) for x in read_lines(path) for ch in x]
    groups = [(5, 4)] * (width // 4) + [(3, 2)] * (width % 4 // 2)
    row = sum(n for n, _ in groups)
    if len(digits) % row or max(digits, default=0) >= 85:
        raise PanicError(SYNTAX_ERROR, "a row isn't whole")
    pixels, at = [], 0
    for k in range(len(digits) // row):
        col = 0
        for n, count in groups:
            v = 0
            for d in digits[at : at + n]:
                v = v * 85 + d
            pixels += [(k, col + i, v >> 8 * (count - 1 - i) & 255) for i in range(count)]
            at, col = at + n, col + count
    return spark.createDataFrame(pixels, "row int, col int, grey int")
