"""lonja.operators"""
