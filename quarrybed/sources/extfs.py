"""ext2, ext3 and ext4 volumes: a listing of files with their contents' extents."""

from __future__ import annotations

from collections.abc import Iterator

from quarrybed.sources.decoders import DECODERS, _int

LISTING = "status string, path string, kind string, inode bigint, size_bytes bigint, mode int, modified_micros bigint, changed_micros bigint, accessed_micros bigint, extents array<array<bigint>>"
_KINDS = {0x4000: "directory", 0x8000: "file", 0xA000: "symlink"}
DEPTH = 1024


class Volume:
    def __init__(self, data: bytes):
        self.data, sb = data, data[1024:2048]
        self.ok = _int(sb, 56, 2) == 0xEF53 and _int(sb, 24, 4) <= 6
        if not self.ok:
            return
        self.block = 1024 << _int(sb, 24, 4)
        self.inodes, self.per_group = _int(sb, 0, 4), max(1, _int(sb, 40, 4))
        self.inode_size = _int(sb, 88, 2) if _int(sb, 76, 4) else 128
        wide = bool(_int(sb, 96, 4) & 0x80)
        self.desc = max(32, _int(sb, 254, 2)) if wide else 32
        self.groups = (_int(sb, 20, 4) + 1) * self.block

    def inode(self, n: int) -> bytes:
        if not 0 < n <= self.inodes:
            return b""
        group, index = divmod(n - 1, self.per_group)
        d = self.data[self.groups + group * self.desc :][: self.desc]
        table = _int(d, 8, 4) | (_int(d, 40, 4) << 32 if self.desc >= 64 else 0)
        at = table * self.block + index * self.inode_size
        return self.data[at : at + self.inode_size]

    def extents(self, ino: bytes) -> list[tuple[int, int, int]]:
        """(first logical block, first physical block, blocks) in order; holes are left out."""
        out: list[tuple[int, int, int]] = []
        if _int(ino, 32, 4) & 0x80000:
            stack = [(ino[40:100], 0)]
            while stack:
                node, level = stack.pop()
                if _int(node, 0, 2) != 0xF30A or level > 5:
                    continue
                deep = _int(node, 6, 2)
                for i in range(min(_int(node, 2, 2), (len(node) - 12) // 12)):
                    e = node[12 + 12 * i : 24 + 12 * i]
                    if deep:
                        b = _int(e, 4, 4) | _int(e, 8, 2) << 32
                        stack.append((self.data[b * self.block : (b + 1) * self.block], level + 1))
                    elif _int(e, 4, 2) <= 32768:  # longer ones are reserved and not yet written
                        out.append((_int(e, 0, 4), _int(e, 8, 4) | _int(e, 6, 2) << 32, _int(e, 4, 2)))
            return sorted(out)
        many, logical = self.block // 4, 0
        work = [(_int(ino, 40 + 4 * i, 4), max(0, i - 11)) for i in range(15)]
        total = -(-self.size(ino) // self.block)
        for b, level in work:
            todo = [(b, level)]
            while todo and logical < total:
                b, level = todo.pop()
                if not b:
                    logical += many**level
                elif level == 0:
                    out.append((logical, b, 1))
                    logical += 1
                else:
                    raw = self.data[b * self.block : (b + 1) * self.block]
                    todo.extend((_int(raw, 4 * i, 4), level - 1) for i in range(many - 1, -1, -1))
        return out

    def size(self, ino: bytes) -> int:
        return _int(ino, 4, 4) | _int(ino, 108, 4) << 32

    def read(self, ino: bytes) -> bytes:
        n = self.size(ino)
        if n > len(self.data) * 2:
            return b""
        out = bytearray(n)
        for logical, physical, count in self.extents(ino):
            part = self.data[physical * self.block : (physical + count) * self.block][: max(0, n - logical * self.block)]
            out[logical * self.block : logical * self.block + len(part)] = part
        return bytes(out[:n])


def ext_volume(data: bytes) -> Iterator[dict]:
    """Every entry below the root, each directory entered once and no deeper than 1,024 levels."""
    v = Volume(data)
    if not v.ok:
        yield {"status": "failed"}
        return
    stack, seen = [(2, "", 0)], {2}
    while stack:
        number, path, depth = stack.pop()
        raw, at = v.read(v.inode(number)), 0
        while at + 8 <= len(raw):
            child, length, n = _int(raw, at, 4), _int(raw, at + 4, 2), raw[at + 6]
            if length < 8:
                yield {"status": "partial", "path": path or "/"}
                break
            name = raw[at + 8 : at + 8 + n].decode("utf-8", "replace")
            at += length
            if not child or name in (".", "..", ""):
                continue
            ino = v.inode(child)
            kind, where = _KINDS.get(_int(ino, 0, 2) & 0xF000, "other"), f"{path}/{name}"
            seconds = lambda o, i=ino: _int(i, o, 4) * 1_000_000 or None
            yield {"status": "recognized" if ino else "partial", "path": where, "kind": kind, "inode": child, "size_bytes": v.size(ino), "mode": _int(ino, 0, 2), "modified_micros": seconds(16), "changed_micros": seconds(12), "accessed_micros": seconds(8), "extents": [list(e) for e in v.extents(ino)] if kind == "file" else []}
            if kind == "directory" and child not in seen and depth < DEPTH:
                seen.add(child)
                stack.append((child, where, depth + 1))


DECODERS["ext_volume"] = (ext_volume, LISTING)
