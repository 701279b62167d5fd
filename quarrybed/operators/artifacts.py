"""Rules over entries and registry observations: which source an entry is, leads on hosts, accounts and secrets."""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrybed.functions.text import ascii_lower, slashes, windows_path
from quarrybed.operators.nested import read_json
from quarrybed.operators.records import first_wins, offset_page

PATH_KEYS = ("source_path_exact", "ntfs_path", "fat_path", "ext_path", "local_relative_path")


def metadata(key: str) -> Column:
    return F.get_json_object("metadata_json", f"$.{key}")


def exact_path() -> Column:
    """The path as the source spells it: the first of several keys that is not empty, else the entry's own path."""
    return F.coalesce(*[F.nullif(metadata(k), F.lit("")) for k in PATH_KEYS], F.col("logical_path"))


#: Name or path endings of the sources, in order of precedence.
_ENDINGS = ((".automaticdestinations-ms", "automatic_jump_list"), (".customdestinations-ms", "custom_jump_list"), (".lnk", "shell_link"), (".pf", "prefetch"), (".evtx", "event_log"))


def classified(entries: DataFrame) -> DataFrame:
    """Entries with ``path_norm`` and ``artifact_source`` (null for entries that are none). The path is computed once."""
    e = entries.withColumn("path_norm", windows_path(exact_path())).withColumn("name_norm", ascii_lower(F.col("entry_name")))
    p, n = F.col("path_norm"), F.col("name_norm")
    kind = F.when(p.contains("/windows/winsxs/"), F.lit(None).cast("string")).when(p.contains("/windows/system32/tasks/"), "scheduled_task")
    for ending, name in _ENDINGS:
        kind = kind.when(n.endswith(ending) | p.endswith(ending), name)
    stream = (ascii_lower(F.coalesce(metadata("ntfs_base_name"), F.lit(""))) == "$usnjrnl") & (ascii_lower(F.coalesce(metadata("ntfs_data_stream_name"), F.lit(""))) == "$j")
    bin_ = (p.contains("/$recycle.bin/") | p.contains("/recycle.bin/")) & F.substring_index(p, "/", -1).startswith("$i")
    kind = kind.when((n == "$usnjrnl:$j") | p.endswith("/$usnjrnl:$j") | stream, "usn_journal").when((n == "activitiescache.db") | p.endswith("/activitiescache.db"), "activities_cache").when((n == "srudb.dat") | p.endswith("/system32/sru/srudb.dat"), "usage_database").when(bin_, "recycle_bin")
    return e.withColumn("artifact_source", kind)


def candidates(entries: DataFrame) -> DataFrame:
    derived = F.lower(F.coalesce(metadata("windows_artifact_derived"), F.lit("0"))).isin("1", "true")
    return classified(entries.where((F.col("entry_kind") == "file") & ~derived)).where("artifact_source is not null")


def pending(found: DataFrame, committed: DataFrame, parser: str) -> DataFrame:
    """Candidates without a finished result of this parser version. ``committed``: entry_id, parser_name, status."""
    done = committed.where((F.col("parser_name") == parser) & F.col("status").isin("parsed", "partial")).select("entry_id").distinct()
    return found.join(done, "entry_id", "left_anti")


def hive_of(name: Column, path: Column) -> Column:
    """Which registry hive a file is, by its name and where it lies."""
    n, p = ascii_lower(name), windows_path(path)
    config = p.contains("/windows/system32/config/")
    return F.when(n.isin("system", "software", "sam", "security") & config, n).when((n == "ntuser.dat") & (p.contains("/users/") | p.contains("/documents and settings/")), "ntuser.dat").when((n == "usrclass.dat") & p.contains("/microsoft/windows/"), "usrclass.dat").when((n == "amcache.hve") & p.contains("/appcompat/programs/"), "amcache.hve")


def is_startup_key(key: Column) -> Column:
    k = ascii_lower(slashes(key))
    out = F.lit(False)
    for end in ("/currentversion/run", "/currentversion/runonce", "/currentversion/runonceex", "/currentversion/runservices", "/currentversion/policies/explorer/run"):
        out = out | k.endswith(end)
    return out


_HOST = ("hostname", "nv hostname", "domain", "dhcpdomain", "searchlist")
_NET = ("ipaddress", "dhcpipaddress", "defaultgateway", "dhcpdefaultgateway", "nameserver", "dhcpnameserver", "dhcpserver")


def registry_leads(observations: DataFrame) -> DataFrame:
    """Host and network facts, each value once. ``observations``: hive, ordinal, key_path, value_name, value_data,
    last_write_utc. Blank values give none; among equal ones (letters folded) the first by ordinal stays."""
    key, name, hive = ascii_lower(slashes(F.col("key_path"))), ascii_lower(F.col("value_name")), ascii_lower(F.col("hive"))
    value = F.trim("value_data")
    tcp = (hive == "system") & key.contains("/services/tcpip/parameters")
    nt = "/microsoft/windows nt/currentversion"
    kind = F.when((hive == "system") & key.contains("/control/computername/computername") & (name == "computername"), "computer_name").when(tcp & name.isin(*_HOST), "host_or_domain_name").when(tcp & name.isin(*_NET), "ip_dns_gateway_or_dhcp").when((hive == "software") & key.contains(f"{nt}/networklist/profiles/") & name.isin("profilename", "description", "dnssuffixname"), "windows_network_profile").when((hive == "software") & key.contains(nt) & name.isin("registeredowner", "registeredorganization"), "registered_owner")
    rows = observations.where(value != "").select(kind.alias("lead_type"), "value_name", value.alias("value"), "key_path", "last_write_utc", "ordinal").where("lead_type is not null")
    return first_wins(rows, [F.col("lead_type"), ascii_lower(F.col("value_name")), ascii_lower(F.col("value"))], ["ordinal"])


def domain_accounts(observations: DataFrame) -> DataFrame:
    """Default users with their domains, both from one logon key; local placeholders are none."""
    key = ascii_lower(slashes(F.col("key_path")))
    rows = observations.where((ascii_lower(F.col("hive")) == "software") & key.endswith("/microsoft/windows nt/currentversion/winlogon") & (F.trim("value_data") != ""))
    rows = rows.select(key.alias("k"), ascii_lower(F.col("value_name")).alias("n"), F.trim("value_data").alias("v"), "ordinal")
    last = lambda n: F.max_by(F.when(F.col("n") == n, F.col("v")), F.when(F.col("n") == n, F.col("ordinal")))
    pairs = rows.groupBy("k").agg(last("defaultusername").alias("u1"), last("defaultdomainname").alias("d1"), last("altdefaultusername").alias("u2"), last("altdefaultdomainname").alias("d2"))
    flat = pairs.select("k", F.explode(F.array(F.struct(F.lit(0).alias("i"), F.col("u1").alias("account"), F.col("d1").alias("domain")), F.struct(F.lit(1).alias("i"), F.col("u2").alias("account"), F.col("d2").alias("domain")))).alias("x")).select("k", "x.*")
    flat = flat.where("account is not null and domain is not null").where((F.col("domain") != ".") & (ascii_lower(F.col("domain")) != "localhost"))
    return first_wins(flat, [ascii_lower(F.col("domain")), ascii_lower(F.col("account"))], ["k", "i"]).select("account", "domain", F.concat_ws("\\", "domain", "account").alias("qualified_account"))


def key_fields(observations: DataFrame) -> DataFrame:
    """The values of each key as a map with folded names; of equal names the least value stays."""
    rows = observations.groupBy("key_path", ascii_lower(F.col("value_name")).alias("n")).agg(F.min("value_data").alias("v"))
    return rows.groupBy("key_path").agg(F.map_from_entries(F.collect_list(F.struct("n", "v"))).alias("fields"))


#: What keeps credentials, as (label, file names, name endings, parts of the folded path). The first row that fits names the store.
CREDENTIAL_STORES = (
    ("Windows account credential database", "sam security ntds.dit", "", ()),
    ("Browser saved-login store", "logins.json key3.db key4.db", "", ("/login data$",)),
    ("Password manager database", "", ".kdbx .psafe3", ()),
    ("Windows Credential Manager or Vault store", "", ".vcrd .vpol", ("/microsoft/credentials/", "/microsoft/vault/")),
    ("Windows DPAPI master-key material", "", "", ("/microsoft/protect/",)),
    ("SSH private key", "", "", ("/[.]ssh/(?:.*/)?id_(?:rsa|dsa|ecdsa|ed25519)$",)),
    ("AWS credential configuration", "", "", ("/[.]aws/credentials$",)),
    ("Cloud authentication token store", "accesstokens.json azureprofile.json msal_token_cache.json", "", ()),
)
#: Files that hold secrets in plain text, by name or by path.
PLAINTEXT_NAMES = "[.]env(?:[.][^/]*)?|[.]git-credentials|[.]netrc|[.]npmrc|[.]pypirc|pip[.]conf|(?:auto)?unattend[.]xml|accesstokens[.]json|application_default_credentials[.]json|msal_token_cache[.]json"
PLAINTEXT_PATHS = "/[.]aws/(?:.*/)?credentials|/[.]docker/(?:.*/)?config[.]json|/[.]kube/(?:.*/)?config|/microsoft/usersecrets/(?:.*/)?secrets[.]json"
#: Keys that are secrets as a whole, and last words of those that are.
SECRET_KEY = re.compile(r"password|passwd|pwd|secret|token|auth|authorization|keymaterial|.*_(?:password|passwd|secret|token|(?:api|access|private|session)_key|connection_string)")


def _file_of(path: Column, name: Column) -> Column:
    """Folder and name as one folded path with a leading slash; null without a name."""
    return F.concat(F.lit("/"), ascii_lower(slashes(F.concat(F.coalesce(path, F.lit("")), F.lit("/"), name))))


def _store_pattern(names: str, endings: str, parts: tuple[str, ...]) -> str:
    """One regular expression on the folded path for a row of the table."""
    ways = [f"/(?:{'|'.join(map(re.escape, names.split()))})$"] * bool(names) + [f"(?:{'|'.join(map(re.escape, endings.split()))})$"] * bool(endings)
    return "|".join([*ways, *parts])


def credential_store(path: Column, name: Column) -> Column:
    """What store of credentials a file is by ``CREDENTIAL_STORES``, or null. A null name is none."""
    at = _file_of(path, name)
    return F.coalesce(*[F.when(at.rlike(_store_pattern(*row)), label) for label, *row in CREDENTIAL_STORES])


def plaintext_secret_source(path: Column, name: Column) -> Column:
    """Whether a file is known to hold secrets in plain text. A null name is none."""
    return F.coalesce(_file_of(path, name).rlike(f"(?:/(?:{PLAINTEXT_NAMES})|{PLAINTEXT_PATHS})$"), F.lit(False))


def is_secret_key(key: str) -> bool:
    """Whether a key names a secret: quotes and tag marks around it are dropped, ``-`` and ``.`` join words like ``_``."""
    return bool(SECRET_KEY.fullmatch(re.sub(r"[-.]", "_", key.strip(" \t\r\n\"'<>/")).lower()))


def _in_document(value) -> Iterator[tuple[str, str, str]]:
    """Secrets of parsed JSON at any depth, with their path."""
    stack = [(value, "$")]
    while stack:
        value, where = stack.pop()
        inner = [(k, f"{where}.{k}", v) for k, v in value.items()] if isinstance(value, dict) else [(None, f"{where}[{i}]", v) for i, v in enumerate(value)] if isinstance(value, list) else []
        for key, at, v in inner:
            if isinstance(v, dict | list):
                stack.append((v, at))
            elif key is not None and v not in (None, "") and is_secret_key(key):
                yield key, str(v), at


def _in_addresses(text: str) -> Iterator[tuple[str, str, str]]:
    """Passwords in addresses of stored version-control logins, one a line."""
    for i, line in enumerate(text.splitlines(), 1):
        m = re.match(r"\s*[A-Za-z][\w+.-]*://([^:@/\s]*):([^@/\s]+)@(\S+)", line)
        if m:
            yield f"{m[1]}@{m[3]}", m[2], f"line {i}"


def _in_machines(text: str) -> Iterator[tuple[str, str, str]]:
    """Passwords of network login files: words in pairs, whatever the lines."""
    machine, login, words = "", "", [(w, i) for i, line in enumerate(text.splitlines(), 1) for w in line.partition("#")[0].split()]
    at = 0
    while at < len(words):
        word, _ = words[at]
        value, line = words[at + 1] if at + 1 < len(words) else ("", 0)
        if word == "machine":
            machine, login = value, ""
        elif word == "default":
            machine, login, at = "default", "", at - 1
        elif word == "login":
            login = value
        elif word in ("password", "account") and value:
            if word == "password":
                yield f"{login}@{machine}", value, f"line {line}"
        else:
            at -= 1
        at += 2


def secrets_in(text: str, name: str | None = None) -> Iterator[tuple[str, str, str]]:
    """(key, value, where) of secrets in JSON or XML at any depth, else in assignment lines.

    The file's name chooses the reader of stored logins (``.git-credentials``, ``.netrc``), whose lines are no assignments.
    """
    leaf = re.split(r"[/\\]", name or "")[-1].lower()
    if leaf in (".git-credentials", ".netrc"):
        yield from _in_addresses(text) if leaf == ".git-credentials" else _in_machines(text)
        return
    try:
        yield from _in_document(read_json(text))
        return
    except ValueError:
        pass
    if text.lstrip().startswith("<") and "<!DOCTYPE" not in text.upper() and "<!ENTITY" not in text.upper():
        try:
            for e in ElementTree.fromstring(text).iter():
                tag = e.tag.rpartition("}")[2]
                if is_secret_key(tag) and (e.text or "").strip():
                    yield tag, e.text.strip(), tag
            return
        except ElementTree.ParseError:
            pass
    for i, line in enumerate(text.splitlines(), 1):
        m = re.match(r"\s*(?![#;\[])(?:export\s+)?(?:([^=]*)=(.*)|([^:=]*):(.*))", line)
        key, value = [(x or "").strip() for x in (m[1] or m[3], m[2] or m[4])] if m else ("", "")
        if value.strip("\"'") and is_secret_key(key):
            yield key, value.strip("\"'"), f"line {i}"


def assignment_lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id_col, key_name, value`` of each line ``KEY=VALUE`` or ``KEY: VALUE``, by column expressions alone."""
    pattern = r"^\s*([A-Za-z_][A-Za-z0-9_.\-]*)\s*[=:]\s*(\S.*)$"
    lines = df.select(id_col, F.explode(F.split(text_col, "\n")).alias("line"))
    return lines.select(id_col, F.regexp_extract("line", pattern, 1).alias("key_name"), F.trim(F.regexp_extract("line", pattern, 2)).alias("value")).where("key_name <> ''")


def journal_statistics(records: DataFrame) -> DataFrame:
    """Per source: newest version, different records, those with unknown reasons and those without a time."""
    once = records.select("entry_id", "evidence_id", "usn_version", "unknown_reason_bits", "timestamp_utc").dropDuplicates(["entry_id"])
    return once.groupBy("evidence_id").agg(F.max("usn_version").alias("newest_version"), F.count("*").alias("records"), F.count_if(F.col("unknown_reason_bits") != 0).alias("unknown_reasons"), F.count_if(F.col("timestamp_utc").isNull()).alias("without_time"))


def secret_leads(df: DataFrame, id_col: str, text_col: str, name_col: str | None = None) -> DataFrame:
    """``source_id, secret_key, secret_value, location`` of every secret; null and empty texts have none. ``name_col`` holds
    file names, by which stored logins are read; without it, or where it is null, texts are read by their form alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *hit) for i, t, n in zip(*[c.to_pylist() for c in batch.columns]) if t for hit in secrets_in(t, n)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64() if k == 0 else pa.string()) for k in range(4)], ["source_id", "secret_key", "secret_value", "location"])

    return df.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string"), F.col(name_col).cast("string") if name_col else F.lit(None).cast("string")).mapInArrow(run, "source_id bigint, secret_key string, secret_value string, location string")


def any_time_within(cols: list[Column], start: Column, end: Column) -> Column:
    """Whether any of several stamps lies in an inclusive range."""
    return F.exists(F.array(*cols), lambda t: F.coalesce(t.between(start, end), F.lit(False)))


def first_preview(values: list[Column], most: int = 4) -> Column:
    """The first few values that are not empty, joined by `` | ``."""
    return F.array_join(F.slice(F.filter(F.array(*values), lambda v: F.coalesce(v != "", F.lit(False))), 1, most), " | ")


# Records derived from observations -----------------------------------------------------------------------------------------


def startup_records(observations: DataFrame) -> DataFrame:
    """Programs started with the system or a user, one per value, numbered in order of the hive."""
    rows = observations.where(is_startup_key(F.col("key_path")) & (F.trim("value_data") != ""))
    return rows.select("hive", "key_path", F.col("value_name").alias("entry"), F.trim("value_data").alias("command"), "last_write_utc", "ordinal")


def inventory_records(observations: DataFrame) -> DataFrame:
    """Programs of the application inventory: path of several candidate fields, digest without its leading zeros."""
    key = ascii_lower(slashes(F.col("key_path")))
    wanted = observations.where(key.rlike(r"/(?:inventoryapplicationfile|inventoryapplication|inventorydevicepnp|inventorydriverbinary|inventoryapplicationshortcut|file|programs)/[^/]+$"))
    f = key_fields(wanted)
    field = lambda *names: F.coalesce(*[F.nullif(F.try_element_at("fields", F.lit(n)), F.lit("")) for n in names])
    digest = F.regexp_replace(field("sha1", "fileid", "101"), "^0000", "")
    return f.select("key_path", field("lowercaselongpath", "path", "rootdirpath", "15", "filepath").alias("file_path"), field("name", "0", "productname").alias("name"), digest.alias("sha1"), field("publisher", "1").alias("publisher"), field("version", "productversion").alias("version"), field("linkdate", "installdate").alias("linked"))


def user_assist_names(observations: DataFrame) -> DataFrame:
    """Values below user-assist count keys with their names turned back."""
    from quarrybed.functions.labels import known_folders
    from quarrybed.functions.text import rot13

    key = ascii_lower(slashes(F.col("key_path")))
    rows = observations.where(key.contains("/explorer/userassist/") & key.endswith("/count"))
    return rows.withColumn("program", known_folders(rot13(F.col("value_name"))))


def bag_paths(names: DataFrame) -> DataFrame:
    """Folders of shell bags: each key's path is the names of the keys above it. ``names``: key_path, name."""
    parts = F.split(slashes(F.col("key_path")), "/")
    up = names.select("key_path", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("n", "prefix"))
    known = names.select(F.array_join(parts, "/").alias("prefix"), "name")
    return up.join(known, "prefix").groupBy("key_path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "name"))), lambda x: x["name"]), "\\").alias("folder_path"))


#: The keys of a record's four times, in order of preference.
TIME_KEYS = {"modified": ("ntfs_modified_utc", "ext_mtime_utc", "fat_modified_utc", "modified_utc"), "accessed": ("ntfs_accessed_utc", "ext_atime_utc", "fat_accessed_utc", "accessed_utc"), "changed": ("ntfs_record_changed_utc", "ext_ctime_utc", "changed_utc"), "born": ("ntfs_created_utc", "ext_crtime_utc", "fat_created_utc", "created_utc")}


def four_times() -> list[Column]:
    """Modified, accessed, changed and born: the first stamp present of each."""
    return [F.coalesce(*[F.nullif(metadata(k), F.lit("")) for k in keys]).alias(f"{role}_utc") for role, keys in TIME_KEYS.items()]


def category_counts(df: DataFrame, main: Column, sub: Column) -> DataFrame:
    """Entries per category; a null main category is the uncategorised one."""
    return df.groupBy(F.coalesce(main, F.lit("Uncategorized")).alias("category_main"), sub.alias("category_sub")).agg(F.count("*").alias("entries"))


def entry_by_id(df: DataFrame, entry_id: int) -> DataFrame:
    """Point lookup; the filter reaches the scan."""
    return df.where(F.col("entry_id") == entry_id)


def folder_page(df: DataFrame, parent: str, offset: int, size: int | None) -> DataFrame:
    """Children of a folder by name, one page by position."""
    below = df.where(F.col("logical_path").startswith(parent.rstrip("/") + "/"))
    direct = below.where(~F.contains(F.substr("logical_path", F.lit(len(parent.rstrip("/")) + 2)), F.lit("/")))
    return offset_page(direct, [ascii_lower(F.col("entry_name")), "entry_id"], offset, size)


def below_folder(df: DataFrame, parent: str) -> DataFrame:
    """Everything at any depth below a folder, as for a recursive bookmark."""
    return df.where(F.col("logical_path").startswith(parent.rstrip("/") + "/"))


def category_page(df: DataFrame, name: str | None = None, extension: str | None = None, kind: str | None = None, deleted: bool | None = None, sha256: str | None = None, start: str | None = None, end: str | None = None, times: list[str] | None = None) -> DataFrame:
    """Entries of a category page: each filter given narrows it; both bounds of time must be given to count."""
    if name:
        df = df.where(ascii_lower(F.col("entry_name")).contains(name.lower()))
    if extension:
        df = df.where(ascii_lower(F.col("entry_name")).endswith("." + extension.lower().lstrip(".")))
    if kind:
        df = df.where(F.col("entry_kind") == kind)
    if deleted is not None:
        df = df.where(F.col("is_deleted") == deleted)
    if sha256:
        df = df.where(F.lower(metadata("sha256")) == sha256.lower())
    if start and end and times:
        df = df.where(any_time_within([metadata(t).try_cast("timestamp") for t in times], F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))
    return df


def visible(df: DataFrame) -> DataFrame:
    """Entries whose category is not hidden."""
    return df.where(~F.lower(F.coalesce(metadata("category_hidden"), F.lit("0"))).isin("1", "true"))


def genuine(df: DataFrame) -> DataFrame:
    """Entries of the file system's own tree, not derived records."""
    return df.where(metadata("artifact_kind").isin("filesystem_entry", "deleted_file_record"))


def display_path(path: Column, containers: tuple[str, ...] = ("/evidence", "/image", "/volume")) -> Column:
    """A path without its container prefix, cut at a segment."""
    out = path
    for c in containers:
        out = F.when(path.startswith(c + "/"), F.substr(path, F.lit(len(c) + 1))).otherwise(out)
    return out


def subtree_totals(entries: DataFrame) -> DataFrame:
    """Entries and bytes below each folder at any depth: each entry counts for all its ancestors, pre-aggregated."""
    from quarrybed.functions.text import path_prefixes

    up = entries.select(F.explode(path_prefixes(F.col("logical_path"))).alias("folder"), F.coalesce("size_bytes", F.lit(0)).alias("size_bytes"))
    return up.groupBy("folder").agg(F.count("*").alias("entries"), F.sum("size_bytes").alias("bytes"))
