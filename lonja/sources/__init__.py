"""lonja.sources"""
