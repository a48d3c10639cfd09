"""Part of termloom."""
