"""loomframe.plans"""
