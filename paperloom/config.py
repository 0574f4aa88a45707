"""Settings, resolved when a plan is built."""

from __future__ import annotations

import os
from dataclasses import dataclass, replace


@dataclass(frozen=True)
class NormalizeConfig:
    normalize_line_breaks: bool = True
    remove_hyphen_line_breaks: bool = True
    collapse_whitespace: bool = True
    collapse_blank_lines: bool = True
    unicode_normalize: bool = True
    remove_urls: bool = True
    remove_page_numbers: bool = True
    remove_headers_footers: bool = True
    remove_toc_pages: bool = True
    fix_ligatures: bool = True
    apply_ocr_corrections: bool = False
    fix_broken_sentences: bool = True
    merge_hyphenated_words: bool = True
    normalize_bullet_points: bool = True
    remove_duplicated_lines: bool = True  # accepted, has no effect
    protect_headings: bool = True
    protect_bullet_points: bool = True
    protect_code_blocks: bool = True
    protect_tables: bool = True
    add_page_markers: bool = True
    page_marker_template: str = "\n\n<<<PAGE_{page_num}>>>\n\n"
    detect_multi_column: bool = True
    preserve_hierarchy: bool = True
    enable_metadata_crosscheck: bool = True
    multi_column_threshold: int = 4
    skip_pages: tuple[int, ...] = ()
    force_process_pages: tuple[int, ...] = ()
    custom_header_patterns: tuple[str, ...] = ()
    custom_protect_patterns: tuple[str, ...] = ()


@dataclass(frozen=True)
class ChunkConfig:
    max_chunk_size: int = 1000
    min_chunk_size: int = 100
    target_chunk_size: int = 500
    overlap_size: int = 100
    overlap_strategy: str = "sentence"  # sentence, character or token
    enable_overlap: bool = True
    keep_tables_intact: bool = True
    keep_code_blocks_intact: bool = True
    keep_bullet_lists_intact: bool = True
    extract_urls: bool = True
    token_aware: bool = False
    # accepted, have no effect
    respect_page_boundaries: bool = True
    respect_section_boundaries: bool = True
    respect_paragraph_boundaries: bool = True
    max_tokens: int | None = None

    def __post_init__(self) -> None:
        if not 0 <= self.min_chunk_size < self.target_chunk_size:
            raise ValueError("min_chunk_size must be under target_chunk_size")


@dataclass(frozen=True)
class PrepareConfig:
    deduplicate: bool = True
    dedup_scope: str = "document"  # or corpus
    aggressive: bool = False
    hash_algorithm: str = "sha256"
    ngram_hash: bool = False
    version: str = "1.0"
    pipeline: str = "default"
    created_at: str = ""


@dataclass(frozen=True)
class ServiceConfig:
    store_path: str = "collections"
    collection: str = "documents"
    embedding_model: str = "hashing-384"
    vector_size: int = 384
    distance: str = "Cosine"
    normalize: NormalizeConfig = NormalizeConfig()
    chunk: ChunkConfig = ChunkConfig()
    prepare: PrepareConfig = PrepareConfig()

    def from_env(self) -> ServiceConfig:
        """Environment variables take precedence over the settings."""
        return replace(self, store_path=os.environ.get("PAPERLOOM_STORE", self.store_path), embedding_model=os.environ.get("EMBEDDING_MODEL", self.embedding_model))
