"""DataFrame-to-DataFrame operators."""

from tidemark.operators.bloom import bloom_size, build_bloom, load_bloom, might_contain, save_bloom
from tidemark.operators.index import index_end, index_floor, load_index, save_index, sparse_index
from tidemark.operators.reads import latest, level_merge, might_contain_series, point_get, range_scan, snapshot
from tidemark.operators.sizes import is_full, offheap_size, onheap_size

__all__ = ["bloom_size", "build_bloom", "load_bloom", "might_contain", "save_bloom", "index_end", "index_floor", "load_index", "save_index", "is_full", "latest", "level_merge", "might_contain_series", "offheap_size", "onheap_size", "point_get", "range_scan", "snapshot", "sparse_index"]
