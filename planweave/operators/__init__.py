"""planweave.operators"""
