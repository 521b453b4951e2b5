"""Furniture of the known site generators.

Fixed values: source type -> class tokens of elements that aren't content.
"""

from __future__ import annotations

SPHINX = "headerlink viewcode-link reference-download sphinxsidebar sphinxsidebarwrapper related sourcelink rst-versions rst-current-version wy-nav-side wy-breadcrumbs-aside"
RUSTDOC = "sub-heading src since anchor copy-path rustdoc-toolbar help-button search-form out-of-band sidebar-elems"
MDBOOK = "nav-chapters mobile-nav-chapters nav-wrapper icon-button menu-bar menu-title right-buttons left-buttons"
DROP_CLASSES: dict[str, frozenset[str]] = {"readthedocs": frozenset(SPHINX.split()), "rustdoc": frozenset(RUSTDOC.split()), "mdbook": frozenset(MDBOOK.split())}
