"""planweave.functions"""
