"""Codes to labels. The maps are fixed values of public formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrybed.functions.text import grouped

TRANSITIONS = {0: "link", 1: "typed", 2: "auto_bookmark", 3: "auto_subframe", 4: "manual_subframe", 5: "generated", 6: "auto_toplevel", 7: "form_submit", 8: "reload", 9: "keyword", 10: "keyword_generated"}
QUALIFIERS = {0x00800000: "blocked", 0x01000000: "forward_back", 0x02000000: "from_address_bar", 0x04000000: "home_page", 0x08000000: "from_api", 0x10000000: "chain_start", 0x20000000: "chain_end", 0x40000000: "client_redirect", 0x80000000: "server_redirect"}
VISIT_SOURCES = {0: "synced", 1: "browsed(local)", 2: "extension", 3: "firefox_imported", 4: "ie_imported", 5: "safari_imported"}
DOWNLOAD_STATES = {0: "in_progress", 1: "complete", 2: "cancelled", 3: "obsolete_bug_140687", 4: "interrupted"}
DANGERS = {0: "not_dangerous", 1: "dangerous_file", 2: "dangerous_url", 3: "dangerous_content", 4: "maybe_dangerous_content", 5: "uncommon_content", 6: "user_validated", 7: "dangerous_host", 8: "potentially_unwanted"}
INTERRUPTS = {
    0: "none", 1: "file_failed", 2: "file_access_denied", 3: "file_no_space", 5: "file_name_too_long", 6: "file_too_large", 7: "file_virus_infected", 10: "file_transient_error", 11: "file_blocked", 12: "file_security_check_failed", 13: "file_too_short", 14: "file_hash_mismatch", 15: "file_same_as_source",
    20: "network_failed", 21: "network_timeout", 22: "network_disconnected", 23: "network_server_down", 24: "network_invalid_request", 30: "server_failed", 31: "server_no_range", 33: "server_bad_content", 34: "server_unauthorized", 35: "server_cert_problem", 36: "server_forbidden", 37: "server_unreachable", 38: "server_content_length_mismatch", 40: "user_canceled", 41: "user_shutdown", 50: "crash",
}
FIREFOX_VISITS = {1: "link", 2: "typed", 3: "bookmark", 4: "embed", 5: "redirect_permanent", 6: "redirect_temporary", 7: "download", 8: "framed_link", 9: "reload"}
FIREFOX_DOWNLOADS = {0: "downloading", 1: "finished", 2: "failed", 3: "canceled", 4: "paused", 5: "queued", 6: "blocked-parental", 7: "scanning", 8: "dirty", 9: "blocked-policy"}
BOOKMARK_ROOTS = {"bookmark_bar": "Bookmarks Bar", "other": "Other Bookmarks", "synced": "Mobile Bookmarks"}
ACTIVITY_TYPES = {5: "User Engagement (App Launch)", 6: "User Engagement (Active Duration)", 10: "User Session", 11: "Device Settings / Sync", 12: "System Notification", 15: "Device Connectivity", 16: "Clipboard"}
#: Known folders by their identifiers.
KNOWN_FOLDERS = {
    "{1AC14E77-02E7-4E5D-B744-2EB1AE5198B7}": "C:\\Windows\\System32",
    "{D65231B0-B2F1-4857-A4CE-A8E7C6EA7D27}": "C:\\Windows\\SysWOW64",
    "{7C5A40EF-A0FB-4BFC-874A-C0F2E0B9FA8E}": "C:\\Program Files (x86)",
    "{6D809377-6AF0-444B-8957-A3773F02200E}": "C:\\Program Files",
    "{F38BF404-1D43-42F2-9305-67DE0B28FC23}": "C:\\Windows",
    "{82A5EA35-D9CD-47C5-9629-E15D2F714E6E}": "C:\\ProgramData",
    "{3EB685FD-984F-4E40-AC96-E7865239C0F2}": "AppData\\Roaming",
    "{F1B32785-6FBA-4FCF-9D55-7B8E7F157091}": "AppData\\Local",
}
RECIPIENTS = {1: "To", 2: "Cc", 3: "Bcc"}


def label(code: Column, names: dict, otherwise: str = "unknown ({})") -> Column:
    """The label of a code; an unknown code fills ``{}`` of ``otherwise``; a null code gives null."""
    m = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    head, _, tail = otherwise.partition("{}")
    rest = F.concat(F.lit(head), code.cast("string"), F.lit(tail)) if "{}" in otherwise else F.lit(otherwise)
    return F.when(code.isNotNull(), F.coalesce(F.try_element_at(m, code.cast("int") if isinstance(next(iter(names)), int) else code), rest))


def transition_type(t: Column) -> Column:
    return label(t.bitwiseAND(F.lit(0xFF)), TRANSITIONS, "unknown")


def transition_qualifiers(t: Column) -> Column:
    pairs = F.array(*[F.struct(F.lit(b).cast("bigint").alias("b"), F.lit(n).alias("n")) for b, n in QUALIFIERS.items()])
    return F.transform(F.filter(pairs, lambda p: t.cast("bigint").bitwiseAND(p.b) != 0), lambda p: p.n)


def is_redirect(t: Column) -> Column:
    return F.arrays_overlap(transition_qualifiers(t), F.array(F.lit("client_redirect"), F.lit("server_redirect")))


def is_user_initiated(t: Column) -> Column:
    return transition_type(t).isin("typed", "auto_bookmark", "generated", "form_submit", "reload", "keyword", "keyword_generated") | F.array_contains(transition_qualifiers(t), "from_address_bar")


def visit_source(c: Column) -> Column:
    return F.coalesce(label(c, VISIT_SOURCES), F.lit("local"))


def percent_complete(received: Column, total: Column) -> Column:
    return F.when(total > 0, received / total * 100.0)


def download_outcome(state: Column, received: Column, total: Column, duration: Column, reason: Column) -> Column:
    """What became of a download, in one line; null if nothing is known of it."""
    text = F.coalesce(label(state, DOWNLOAD_STATES), F.lit("download"))
    why = label(reason, INTERRUPTS)
    maybe = lambda cond, *parts: F.when(cond, F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])).otherwise("")
    both, took = received.isNotNull() & total.isNotNull(), duration.isNotNull()
    after, cause = maybe(took, " after ", duration), maybe(why != "none", " - ", why)
    percent = maybe(total > 0, " (", F.format_string("%.0f", percent_complete(received, total)), "%)")
    progress = F.when(both, F.concat(F.lit(" at "), grouped(received), F.lit(" of "), grouped(total), F.lit(" bytes"), percent)).when(received.isNotNull(), F.concat(F.lit(" after receiving "), grouped(received), F.lit(" bytes"))).when(total.isNotNull(), F.concat(F.lit(" with "), grouped(total), F.lit(" bytes expected"))).otherwise("")
    size = F.coalesce(received, total)
    line = F.when(state == 4, F.concat(text, progress, after, cause)).when(state == 1, F.concat(text, maybe(size.isNotNull(), " - ", grouped(size), " bytes"), maybe(took, " in ", duration))).otherwise(F.concat(text, maybe(both, " - ", grouped(received), " of ", grouped(total), " bytes"), after, cause))
    return F.when(F.coalesce(state.cast("string"), received.cast("string"), total.cast("string"), duration, why).isNotNull(), line)


def known_folders(path: Column) -> Column:
    for guid, folder in KNOWN_FOLDERS.items():
        path = F.replace(path, F.lit(guid), F.lit(folder))
    return path


def application_of(raw: Column) -> Column:
    """STRUCT<application, platform>: the first named application of a JSON array, or the plain text itself."""
    t = F.trim(raw)
    items = F.filter(F.from_json(t, "array<struct<application string, platform string>>"), lambda x: F.trim(x.application) != "")
    first = F.get(items, F.lit(0))
    listed = t.startswith("[") & items.isNotNull()
    return F.when(t != "", F.struct(known_folders(F.when(listed, F.trim(first.application)).otherwise(t)).alias("application"), F.when(listed, first.platform).alias("platform")))
