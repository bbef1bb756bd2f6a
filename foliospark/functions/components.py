"""Connected components of links within pages, in one exchange by page."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def least_reachable(links: DataFrame) -> DataFrame:
    """image_id, node, least: for each node of links (image_id, a, b) the least node of its page that links lead to, itself included.

    Links of a page are two numbers each and must fit a task; they are hooked to least neighbours and shortened in numpy. No column is null.
    """

    def label(table: pa.Table) -> pa.Table:
        a, b = table.column("a").to_numpy(), table.column("b").to_numpy()
        node, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
        x, y = ends[: len(a)], ends[len(a) :]
        least = np.arange(len(node))
        while True:
            p, q = least[x], least[y]
            apart = p != q
            if not apart.any():
                break
            to = np.minimum(p, q)[apart]
            np.minimum.at(least, p[apart], to)
            np.minimum.at(least, q[apart], to)
            while (least[least] != least).any():
                least = least[least]
        page = np.full(len(node), table.column("image_id")[0].as_py(), np.int64)
        return pa.table({"image_id": page, "node": node, "least": node[least]})

    return links.select("image_id", "a", "b").groupBy("image_id").applyInArrow(label, "image_id long, node long, least long")
