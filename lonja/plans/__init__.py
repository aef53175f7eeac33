"""lonja.plans"""
