"""Names, paths, sheet tokens and output templates, as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions of audio files, device names that no file may have, and folders that a scan leaves out.
AUDIO = ("flac", "wav", "ape", "wv", "tak", "aiff", "aif")
RESERVED = ("CON", "PRN", "AUX", "NUL", *(f"{d}{i}" for d in ("COM", "LPT") for i in range(1, 10)))
PRUNED = ("out", "output", "split")


def strip(x: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def basename_no_ext(name: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(name, r"([^/\\]*)$", 1), r"(?s)(?<=.)\.[^.]*$", "")


def normalize_dir(path: Column) -> Column:
    return F.lower(F.regexp_replace(path, r"[/\\]+$", ""))


def parent_of(path: Column) -> Column:
    return normalize_dir(F.regexp_extract(path, r"^(.*)[/\\]", 1))


def is_audio(name: Column) -> Column:
    return F.lower(name).rlike(r"\.(" + "|".join(AUDIO) + ")$")


def is_sheet(name: Column) -> Column:
    return F.lower(name).endswith(".cue")


def container(name: Column) -> Column:
    n = F.lower(name)
    return F.when(n.endswith(".flac"), "Flac").when(n.rlike(r"\.(wav|aiff|aif)$"), "Wav").when(n.endswith(".ape"), "Ape").otherwise("Other")


def kept_dir(relative_dir: Column) -> Column:
    """Whether a scan goes into this folder: none of its parts below the root is hidden or an output folder."""
    bad = lambda p: p.startswith(".") | F.lower(p).isin(*PRUNED)
    return ~F.exists(F.split(relative_dir, "/"), bad)


def tokens(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit(r'(?U)(?:"[^"]*"?|[^\s"])+'), 0)


def unquote(raw: Column) -> Column:
    t = strip(raw)
    return F.when((F.length(t) >= 2) & t.startswith('"') & t.endswith('"'), F.substr(t, F.lit(2), F.length(t) - 2)).otherwise(t)


def _literal(v: Column) -> Column:
    """v as a replacement that stands for itself."""
    return F.regexp_replace(v, r"([\\$])", r"\\$1")


#: The names that a template may hold, in the order in which they are filled in, and the usual templates.
VARIABLES = ("title", "artist", "album", "album_artist", "year", "genre", "disc", "track")
PRESETS = (
    ("{album_artist}/{album}", "{track:02d}. {title}"), ("{album}", "{track:02d} - {title}"), ("{album_artist} - {album}", "{track:02d}. {title}"),
    ("", "{track:02d}. {artist} - {title}"), ("[{year}] {album}", "{track:02d}. {title}"),
)


def checked_template(file: str) -> str:
    """A file template, which must hold {title}."""
    if "{title}" not in file:
        raise ValueError("a file template must contain {title}")
    return file


def apply_vars(template: Column, v: dict[str, Column]) -> Column:
    """Template with {track} and {track:0Nd} filled in, then VARIABLES (values are looked through again for later ones), other
    {…} removed, ends stripped.  The album's artist is the track's where there is none."""
    number = v["track"].cast("string")
    v = v | {"album_artist": F.coalesce(v["album_artist"].cast("string"), v["artist"].cast("string"))}
    widths = F.array_distinct(F.regexp_extract_all(template, F.lit(r"(?i)\{track:0([0-9]+)d\}"), F.lit(1)))

    def padded(out: Column, width: Column) -> Column:
        size = F.greatest(F.coalesce(width.try_cast("int"), F.lit(0)), F.length(number))
        return F.regexp_replace(out, F.concat(F.lit(r"(?i)\{track:0"), width, F.lit(r"d\}")), F.lpad(number, size, "0"))

    out = F.aggregate(widths, F.regexp_replace(template, F.lit(r"(?i)\{track\}"), number), padded)
    for key in VARIABLES:
        out = F.regexp_replace(out, F.lit(r"(?i)\{" + key + r"\}"), _literal(F.coalesce(v[key].cast("string"), F.lit(""))))
    return strip(F.regexp_replace(out, r"\{[^{}]+\}", ""))


def name_context(track: Column, album: Column) -> dict[str, Column]:
    """The values of VARIABLES from a track (number, title, performer) and its album (title, performer, date, genre)."""
    number = track["number"]
    return {"track": number, "title": F.coalesce(track["title"], F.concat(F.lit("Track "), number.cast("string"))), "artist": F.coalesce(track["performer"], album["performer"]), "album": album["title"], "album_artist": album["performer"], "year": album["date"], "genre": album["genre"], "disc": F.lit(None).cast("string")}


def tag_pairs(track: Column, album: Column) -> Column:
    """array<struct<k, v>> of the tags of a track, without blank ones."""
    text = lambda c: F.coalesce(c, F.lit(""))
    number = track["number"].cast("string")
    pairs = (("title", text(track["title"])), ("artist", text(F.coalesce(track["performer"], album["performer"]))), ("album", text(album["title"])), ("albumartist", text(album["performer"])), ("album_artist", text(album["performer"])), ("track", number), ("tracknumber", number), ("genre", text(album["genre"])), ("date", text(album["date"])))
    return F.filter(F.array(*(F.struct(F.lit(k).alias("k"), c.alias("v")) for k, c in pairs)), lambda p: strip(p["v"]) != "")


def sanitize(segment: Column) -> Column:
    s = strip(F.regexp_replace(segment, r'[<>:"/\\|?*\x00-\x1f]', "_"))
    s = F.regexp_replace(s, r"\.+$", "")
    s = F.when(s == "", "_").otherwise(s)
    return F.when(F.upper(s).isin(*RESERVED), F.concat(F.lit("_"), s)).otherwise(s)


def render_directory(template: Column, v: dict[str, Column]) -> Column:
    parts = F.filter(F.split(apply_vars(template, v), r"[/\\]"), lambda p: ~strip(p).isin("", "."))
    return F.array_join(F.transform(parts, sanitize), "/")


def render_file(template: Column, v: dict[str, Column], extension: str = "flac") -> Column:
    name = sanitize(F.regexp_replace(apply_vars(template, v), r"[/\\]", "_"))
    return F.when(F.lower(name).endswith(f".{extension.lower()}"), name).otherwise(F.concat(name, F.lit(f".{extension}")))


def render_path(directory: Column, file: Column) -> Column:
    return F.when(directory == "", file).otherwise(F.concat_ws("/", directory, file))


def vorbis_key(key: Column) -> Column:
    k = F.replace(F.upper(strip(key)), F.lit("-"), F.lit("_"))
    return F.when(k.isin("ALBUM_ARTIST", "ALBUM ARTIST"), "ALBUMARTIST").when(k.isin("TRACK_NUMBER", "TRACKNR"), "TRACKNUMBER").otherwise(k)


def vorbis_tags(pairs: Column) -> Column:
    """KEY=value strings of array<struct<k, v>>, without blanks and repeats, in order."""
    good = F.filter(pairs, lambda p: (strip(F.coalesce(p["k"], F.lit(""))) != "") & (strip(F.coalesce(p["v"], F.lit(""))) != ""))
    return F.array_distinct(F.transform(good, lambda p: F.concat(vorbis_key(p["k"]), F.lit("="), p["v"])))
