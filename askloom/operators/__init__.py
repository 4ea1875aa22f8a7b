"""Part of askloom; see the README for the layout."""
