"""Spoken-media analytics as DataFrame operators over corpora of transcribed recordings."""
