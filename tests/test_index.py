"""An index that is kept up to date equals one built anew."""

from __future__ import annotations

import random

from corvane.functions import imports
from corvane.operators import graph, index
from corvane.sources import corpus


def table(spark, files):
    rows = [(f, len(x.encode()), t, x) for f, (x, t) in files.items()]
    return spark.createDataFrame(rows, "file string, n_bytes bigint, mtime_ms bigint, source string")


def rows_of(df):
    return sorted((r.file, r.line, r.kind, r.spec, tuple(r.local), tuple(r.source), r.target, r.status) for r in df.collect())


def text(r):
    return "".join(f"from .m{r.randrange(14)} import f, g as h\n" for _ in range(r.randrange(3))) + ("import './n.js'\n" if r.random() < 0.2 else "")


def test_updates_equal_a_rebuild(spark, tmp_path):
    r, root = random.Random(6), str(tmp_path)
    files = {f"a/m{i}.py": (text(r), 1) for i in range(10)} | {"web/app.ts": ("import { x } from './lib'\n", 1)}
    assert index.read(spark, root, "1") is None
    old = table(spark, files)
    index.update(old.limit(0).select("file", "n_bytes", "mtime_ms"), old, root, "1", buckets=16)
    for step in range(3):
        new = dict(files)
        for f in r.sample(sorted(new), 2):
            del new[f]
        for i in r.sample(range(14), 2):
            new[f"a/m{i}.py"] = (text(r), step + 2)
        if step == 1:
            # a second file that an import may mean makes it ambiguous
            new |= {"web/lib.ts": ("export const x = 1\n", 1), "web/lib.js": ("", 1), "web/app.ts": ("import { x } from './lib'\n", 1)}
        before = corpus.latest(spark, root, "1")["parts"]
        now = table(spark, new)
        done = index.update(table(spark, files).select("file", "n_bytes", "mtime_ms"), now, root, "1", buckets=16)
        assert rows_of(index.read(spark, root, "1")) == rows_of(graph.resolved(imports.all_imports(now, corpus.plain_lines(now)), now))
        after = corpus.latest(spark, root, "1")["parts"]
        kept = [k for k in before if after.get(k) == before[k]]
        assert done["parsed"] == sum(files.get(f) != x for f, x in new.items()) and len([k for k in before if k not in kept]) <= done["imports"] + done["paths"]
        files = new
    # nothing to do: every bucket stays, and no file is parsed
    same = table(spark, files)
    before = corpus.latest(spark, root, "1")["parts"]
    assert index.update(same.select("file", "n_bytes", "mtime_ms"), same, root, "1", buckets=16) == {"parsed": 0, "imports": 0, "paths": 0}
    assert corpus.latest(spark, root, "1")["parts"] == before
