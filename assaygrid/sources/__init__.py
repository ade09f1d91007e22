"""Readers and writers: text tables, quantifier files, gene sets, assay folders, results."""
