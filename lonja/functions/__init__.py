"""lonja.functions"""
