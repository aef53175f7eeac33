"""lonja.streaming"""
