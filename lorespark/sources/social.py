"""Posts and videos as text: what a platform's payload holds, assembled in columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .files import duration, expand_links

# What is read of a payload, and how much of a description is shown.
_WHO = "text string, user struct<screen_name:string,name:string>"
TWEET = (
    f"{_WHO}, entities struct<urls:array<struct<url:string,expanded_url:string>>>, article struct<title:string,preview_text:string>, "
    "parent struct<text:string,user:struct<screen_name:string,name:string>>, quoted_tweet struct<text:string,user:struct<screen_name:string,name:string>>, mediaDetails array<struct<ext_alt_text:string>>"
)
VIDEO = "title string, uploader string, channel string, upload_date string, duration double, description string, chapters array<struct<start_time:double,title:string>>"
SHOWN = 1500


def _some(text: Column) -> Column:
    """Trimmed text, null if it is blank."""
    return F.nullif(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", ""), F.lit(""))


def _line(post: Column, before: str) -> Column:
    handle = _some(post.user.screen_name)
    return F.when(_some(post.text).isNotNull(), F.concat(F.lit(before), F.when(handle.isNotNull(), F.concat(F.lit("@"), handle, F.lit(": "))).otherwise(""), _some(post.text)))


def tweet_text(payload: Column) -> Column:
    """Author, text with its short links expanded, article, what it replies to and quotes, and image texts; empty if there is neither text nor article."""
    t = F.from_json(payload, TWEET)
    urls = F.filter(F.coalesce(t.entities.urls, F.array().cast("array<struct<url:string,expanded_url:string>>")), lambda u: (F.coalesce(u.url, F.lit("")) != "") & (F.coalesce(u.expanded_url, F.lit("")) != ""))
    text = F.nullif(expand_links(F.coalesce(_some(t.text), F.lit("")), urls), F.lit(""))
    title, preview = F.concat(F.lit("Article: "), _some(t.article.title)), _some(t.article.preview_text)
    handle, name = _some(t.user.screen_name), _some(t.user["name"])
    by = F.when(handle.isNotNull(), F.concat(F.lit(" by @"), handle, F.coalesce(F.concat(F.lit(" ("), name, F.lit(")")), F.lit("")))).otherwise("")
    images = F.transform(F.filter(F.coalesce(t.mediaDetails, F.array().cast("array<struct<ext_alt_text:string>>")), lambda m: _some(m.ext_alt_text).isNotNull()), lambda m: F.concat(F.lit("Image: "), _some(m.ext_alt_text)))
    parts = [F.concat(F.lit("[Tweet"), by, F.lit("]")), text, title, preview, _line(t.parent, "In reply to "), _line(t.quoted_tweet, "Quoting "), F.nullif(F.array_join(images, "\n\n"), F.lit(""))]
    return F.when(F.coalesce(text, title, preview).isNull(), "").otherwise(F.concat_ws("\n\n", *parts))


def video_text(info: Column, video: Column, transcript: Column) -> Column:
    """Title, channel, day, length, description and chapters of a video as far as they are known, then its transcript."""
    i = F.coalesce(F.from_json(info, VIDEO), F.from_json(F.lit("{}"), VIDEO))
    day = F.when(F.char_length(i.upload_date) == 8, F.concat(F.lit("Published: "), F.substring(i.upload_date, 1, 4), F.lit("-"), F.substring(i.upload_date, 5, 2), F.lit("-"), F.substring(i.upload_date, 7, 2)))
    channel = F.coalesce(F.nullif(i.uploader, F.lit("")), F.nullif(i.channel, F.lit("")))
    meta = F.concat_ws("  |  ", F.concat(F.lit("Channel: "), channel), day, F.when(i.duration.isNotNull(), F.concat(F.lit("Duration: "), duration(F.floor(i.duration)))))
    head = F.concat_ws("\n", F.concat(F.lit("[YouTube Video — ID: "), video, F.lit("]")), F.concat(F.lit("Title: "), F.nullif(i.title, F.lit(""))), F.nullif(meta, F.lit("")))
    about = _some(i.description)
    shown = F.concat(F.lit("Description:\n"), F.left(about, F.lit(SHOWN)), F.when(F.char_length(about) > SHOWN, "...").otherwise(""))
    lines = F.transform(i.chapters, lambda c: F.concat(duration(F.floor(F.coalesce(c.start_time, F.lit(0.0)))), F.lit("  "), F.coalesce(c.title, F.lit(""))))
    chapters = F.when(F.size(i.chapters) > 0, F.concat(F.lit("Chapters:\n"), F.array_join(lines, "\n")))
    return F.concat_ws("\n\n", head, shown, chapters, F.concat(F.lit("Transcript:\n"), transcript))
